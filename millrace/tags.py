"""The known tag names, and the tags and attributes allowed in feeds."""

HTML_TAGS = """a abbr acronym address applet area b base basefont bdo big blockquote body br button caption center cite
code col colgroup dd del dfn dir div dl dt em fieldset font form frame frameset h1 h2 h3 h4 h5 h6 head hr html i iframe
img input ins isindex kbd label legend li link map menu meta noframes noscript object ol optgroup option p param pre q s
samp script select small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul
var""".split()

MATH_TAGS = """abs and annotation annotation-xml apply arccos arcsin arctan bvar ci cn compose condition conjugate cos
cosh cot coth csc csch declare degree determinant diff divide eq exists exp factorial fn forall gcd geq gt ident implies
in int intersect interval inverse lambda leq limit list ln log logbase lowlimit lt maction maligngroup malignmark math
matrix matrixrow max mean median merror mfenced mfrac mi min minus mmultiscripts mn mo mode moment mover mpadded mphantom
mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover neq none not notin
notprsubset notsubset or partialdiff plus power product prsubset quotient reln rem root sdev sec sech selector semantics
sep set setdiff sin sinh subset sum tan tanh tendsto times transpose union uplimit variance vector xor""".split()

OLD_TAGS = """bgsound blink embed ilayer keygen layer listing marquee multicol nobr nbr noembed nolayer plaintext spacer
wbr xmp""".split()

KNOWN_INVALID_TAGS = """cadv contentbanner forum heiseadvert heisetext image skyscraper u2uforen update htmlpromo noindex
quote csscriptdict csactiondict csobj x-claris-window x-claris-tagview x-sas-window nyt_copyright""".split()

# Tags that have no end tag.
NO_CLOSE_TAGS = "img image meta br link area".split()

FEED_ALLOWED = {
    "a": ["href"], "div": [], "span": [], "br": ["clear"], "hr": [], "p": [],
    "img": ["src", "width", "height", "alt", "title", "border", "align", "vspace", "hspace"],
    "b": [], "strong": [], "em": [], "i": [], "code": [], "sub": [], "sup": [], "blockquote": [], "cite": [],
    "table": [], "tbody": [], "thead": [], "tfoot": [], "ul": [], "ol": [], "li": [],
    "tr": ["align"], "th": ["align"], "td": ["align", "colspan", "rowspan"],
}

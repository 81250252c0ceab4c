"""Near-duplicate lines by a segment-partition edit join (operator 8). DataFrame functions only.

A line is dropped if an equal line, or a chain of lines each within some edits (insertion, deletion or
substitution of a character) of the next, leads to an earlier line; "earlier" is by document id, then place.
Blank lines always stay. Lines under ``fuzzy_from`` characters are compared for equality only: a few edits turn
such a line into any other. How many edits: one for each ``share`` characters of the shorter line, ``edits`` at
least and ``most`` at most (the probes of a line grow with the cube of its edits).

1. Equal lines: thin rows (two hashes of the line, its place) are grouped, all places but the first go.
   What remains are texts in which every line occurs once in the whole table.
2. Keys: a line with K edits is cut into K + 1 segments, indexed by number, line length and text. Of two lines
   within K edits, one segment of the shorter stands in the longer one at a shift that its number and the difference
   of lengths bound; just these substrings are looked up, each length with the segments of its own K. A line's own
   segments are among its substrings, so they are made once. Only a key and the line's hash move, and only the keys under
   which a segment and another line meet are kept, a row for each line and key.
3. Pairs: texts of the lines with such keys are fetched (a Bloom filter of at most ``BITS`` bits sifts out others where
   they are read) and their letters counted. Lines under one key become a pair only if length and letters
   allow it, which the join itself tests. A key of more than ``HOT`` lines is compared with one of them first; what
   this links is one group, inside which no more pairs are made. Pairs are verified by edit distance, those of lines
   over ``LONG`` characters bit-parallel in a diagonal band.
4. Linked lines form components; all but the first line of each go.

Defined results: null text is empty, and an empty text stays one blank line. Rows that repeat id and text are
one document and are cut alike. Ids may be null and come first. All columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.let import let
from millrace.llm.components import components
from millrace.llm.shared import cut
from millrace.operators.verdict import filter_of

#: Least and most edits, characters for each edit, length from which lines are compared by edits, most bits of a Bloom filter.
EDITS, MOST, SHARE, FUZZY_FROM, BITS = 1, 2, 40, 24, 1 << 26
#: Letters that are counted before two lines are compared.
COMMON = " eaionrstluhdcmfgwyp"
#: Lines under one key from which they are grouped around one of them first; length up to which the built-in distance is taken.
HOT, LONG = 64, 500


def places(docs: DataFrame) -> DataFrame:
    """rid, id, pos, line of every line that is not blank."""
    rows = docs.select("rid", "id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "")


def edits_of(length: Column, edits: int, most: int, share: int) -> Column:
    """Edits within which a line of this length is near a longer one."""
    return F.greatest(F.lit(edits), F.least(F.floor(length / share).cast("int"), F.lit(most)))


def probe_specs(classes: range) -> list[tuple[int, int, int, int]]:
    """(edits, number, less, shift) of the substrings to look up for lines that are ``less`` characters shorter; no less and no shift: the line's segments."""
    return [
        (k, i, less, shift) for k in classes for less in range(k + 1) for i in range(k + 1)
        for shift in range(max(-i, less - (k - i)), min(i, less + k - i) + 1)
    ]


def keyed(lines: DataFrame, specs: list[tuple[int, int, int, int]], edits: int, most: int, share: int) -> DataFrame:
    """h1, key, segment: the hash of each line, its keys and if they are its segments; a substring that would leave the line has none.

    The specs are exploded beside the line, so that one small expression makes all keys.
    """
    fields = ("k", "i", "less", "shift")
    table = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, spec, strict=True)]) for spec in specs])
    rows = lines.select("h1", "line", F.length("line").alias("n"), F.explode(table).alias("s"))
    rows = rows.select("h1", "line", "n", *[f"s.{f}" for f in fields]).withColumn("of", F.col("n") - F.col("less"))
    rows = rows.where(edits_of(F.col("of"), edits, most, share) == F.col("k"))
    cut_at = lambda number: F.floor(F.col("of") * number / (F.col("k") + 1)).cast("int")
    rows = rows.withColumn("start", cut_at(F.col("i"))).withColumn("size", cut_at(F.col("i") + 1) - F.col("start"))
    rows = rows.withColumn("at", F.col("start") + F.col("shift")).where("at >= 0 AND at + size <= n")
    key = F.xxhash64("i", "of", F.substr("line", F.col("at") + 1, F.col("size")))
    return rows.select("h1", key.alias("key"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("segment"))


def counted(lines: DataFrame) -> DataFrame:
    """The lines with their length and how often each common letter stands in them; n, c: array."""
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    return lines.withColumn("n", F.length("line")).withColumn("c", F.array(*[count(c) for c in COMMON]))


def may_be_near(x: str, y: str, edits: int, most: int, share: int) -> Column:
    """False where length (x_n, y_n) and letters (x_c, y_c) alone show more edits: each edit changes all counts together by two at most."""
    rest = lambda t: F.col(f"{t}_n") - sum(F.col(f"{t}_c")[i] for i in range(len(COMMON)))
    apart = sum((F.abs(F.col(f"{x}_c")[i] - F.col(f"{y}_c")[i]) for i in range(len(COMMON))), F.abs(rest(x) - rest(y)))
    allowed = edits_of(F.least(f"{x}_n", f"{y}_n"), edits, most, share)
    return (F.abs(F.col(f"{x}_n") - F.col(f"{y}_n")) <= allowed) & (apart <= allowed * 2)


def named(lines: DataFrame, name: str, *more: str) -> DataFrame:
    """Line columns of ``counted`` with a name in front; h1 gets the name itself."""
    return lines.select(F.col("h1").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "c", *more)])


def sifted(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines whose h1 is among the distinct ``ids``; nearly no others move."""
    return lines.where(filter_of(ids, "h1", most=BITS)(F.col("h1"))).join(ids, "h1", "left_semi")


def sharing(lines: DataFrame, edits: int, most: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(b, key) and (a, key): substrings under keys where the segment of one line meets another line, and the segments among them.

    A line has a row for each of its keys at most, however many lines share one. All keys are dealt out once: the
    count of a key's lines and the rows that stay are taken from the same exchange.
    """
    rows = keyed(lines, probe_specs(range(edits, max(edits, most) + 1)), edits, most, share).repartition("key")
    ends = rows.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.max("segment").alias("segment"))
    met = ends.where(F.col("segment") & (F.col("least") < F.col("most"))).select("key")
    # each key once: the same as a semi-join, which Spark would move below the exchange and so make all keys anew
    found = cut(rows.join(met.hint("shuffle_hash"), "key"), "line-keys")
    return found.select(F.col("h1").alias("b"), "key"), found.where("segment").select(F.col("h1").alias("a"), "key")


def near(pairs: DataFrame, texts: DataFrame, edits: int, most: int, share: int) -> DataFrame:
    """The pairs (a, b, distinct) whose lines are within the edits of the shorter one."""
    left, right = (texts.select(F.col("h1").alias(n), F.col("line").alias(f"{n}_line")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b")
    x, y = F.col("a_line"), F.col("b_line")
    allowed, bound = edits_of(F.least(F.length(x), F.length(y)), edits, most, share), max(edits, most)
    # the built-in distance walks each line once for each letter of the other; beyond the bound it is -1, without its sign the largest integer
    built_in = F.levenshtein(x, y, bound).bitwiseAND(F.lit((1 << 31) - 1))
    apart = F.when(F.greatest(F.length(x), F.length(y)) > LONG, edit_distance(F.split(x, ""), F.split(y, ""), bound)).otherwise(built_in)
    return both.where(apart <= allowed).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller hash first: equally long lines find one another twice."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bit(value: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.lit(1))


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is within ``edits``, else any number above it.

    Equal ends are trimmed first. A band of 2 * edits + 1 rows around the diagonal is one word; vertical
    differences of a column are two words of bits (up, down), and a column takes a few word operations.
    """
    top, mask = 2 * edits, (1 << (2 * edits + 1)) - 1
    same = lambda a, b: F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), b, lambda p, q: F.coalesce(p == q, F.lit(False)))
    lead = lambda a, b: F.array_position(F.concat(F.slice(same(a, b), 1, F.least(F.size(a), F.size(b))), F.array(F.lit(False))), False).cast("int") - 1
    inner = F.struct(x.alias("x"), y.alias("y"), lead(x, y).alias("p"), lead(F.reverse(x), F.reverse(y)).alias("s"))

    def banded(t: Column) -> Column:
        least = F.least(F.size(t["x"]), F.size(t["y"]))
        tail = F.least(t["s"], least - t["p"])
        m, n = F.size(t["x"]) - t["p"] - tail, F.size(t["y"]) - t["p"] - tail

        def column(state: Column, j: Column) -> Column:
            letter = F.get(t["y"], t["p"] + j - 1)
            match = F.lit(0)
            for k in range(top + 1):
                row = j - edits + k
                hit = (row >= 1) & (row <= m) & (F.get(t["x"], t["p"] + row - 1) == letter)
                match = match.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)))

            def step(u: Column) -> Column:
                both = u["vp"].bitwiseAND(u["match"])
                d0 = (both + u["vp"]).bitwiseXOR(u["vp"]).bitwiseOR(u["match"]).bitwiseOR(u["vn"]).bitwiseAND(F.lit(mask))

                def ends(w: Column) -> Column:
                    hp = u["vn"].bitwiseOR(F.bitwise_not(w.bitwiseOR(u["vp"]))).bitwiseAND(F.lit(mask))
                    hn = w.bitwiseAND(u["vp"])
                    down = F.shiftright(w, 1)
                    at = m - j + edits
                    move = F.when(at >= top, F.lit(1) - bit(w, F.lit(top))).otherwise(bit(hp, at) - bit(hn, at))
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"), (state["d"] + move).alias("d"),
                    )

                return F.get(F.transform(F.array(d0), ends), F.lit(0))

            return F.get(F.transform(F.array(F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), match.alias("match"))), step), F.lit(0))

        first = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(edits)).alias("d"))
        counted = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), first, column)["d"]
        return F.when(F.abs(m - n) > edits, F.lit(edits + 1)).when(n == 0, m).otherwise(counted)

    return F.get(F.transform(F.array(inner), banded), F.lit(0))


def near_lines(shared: DataFrame, probes: DataFrame, index: DataFrame, edits: int, most: int, share: int) -> DataFrame:
    """a, b: hashes of lines within the edits of the shorter one; where a key has more than ``HOT`` lines, enough links to join the same ones."""
    texts = cut(counted(shared.select("h1", "line").dropDuplicates(["h1"])), "line-texts")
    left, right = named(texts, "a"), named(texts, "b")
    close = may_be_near("a", "b", edits, most, share)
    probes, index = probes.join(right, "b"), index.join(left, "a")

    # lines of a much used key that are near one of them are one group already: no pairs are made inside it
    hot = cut(index.groupBy("key").agg(F.min("a").alias("a"), F.count("*").alias("n")).where(F.col("n") > HOT).select("key", "a"), "line-hot")
    if hot.isEmpty():
        return near(ordered(probes.join(index, "key").where((F.col("a") != F.col("b")) & close)), texts, edits, most, share)
    first = ordered(probes.join(hot.join(left, "a"), "key").where((F.col("a") != F.col("b")) & close))
    star = cut(near(first, texts, edits, most, share), "line-stars")
    group = components(star)
    of = lambda rows, n: rows.join(group.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")), n, "left").withColumn(f"{n}_root", F.coalesce(f"{n}_root", n))
    rest = of(probes, "b").join(of(index, "a"), "key").where((F.col("a_root") != F.col("b_root")) & close)
    return star.union(near(ordered(rest), texts, edits, most, share))


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Take the lines at the given places (rid, gone: array) out of ``body``."""
    joined = docs.join(drops.hint("shuffle_hash"), "rid", "left")
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = let(F.split("body", "\n"), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    return joined.withColumn("body", F.when(F.col("gone").isNull(), F.col("body")).otherwise(text)).drop("gone")


def without_most(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``without``, where only texts that a Bloom filter of those that lose lines lets through are joined; the others do not move."""
    may_lose = filter_of(drops, "rid", most=BITS)(F.col("rid"))
    return docs.where(~may_lose).unionByName(without(docs.where(may_lose), drops))


def later(places: DataFrame, keys: list[str]) -> DataFrame:
    """rid, gone: of the places that share the keys, all but the first."""
    one = F.struct("id", "rid", "pos")
    first = places.groupBy(*keys).agg(F.min(one).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = places.join(first, keys).where(~((F.col("rid") == F.col("first.rid")) & (F.col("pos") == F.col("first.pos"))))
    return gone.groupBy("rid").agg(F.collect_set("pos").alias("gone"))  # at most the lines of one document


def dedup_lines(df: DataFrame, key: str, text: str, edits: int = EDITS, fuzzy_from: int = FUZZY_FROM, share: int = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``df`` with ``text`` freed of later duplicates; lines_in and lines_out tell what happened."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(key).alias("id"), body.alias("body"))
    docs = docs.withColumn("rid", F.xxhash64("id", "body"))
    hashed = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    thin = cut(places(docs).select("rid", "id", "pos", *hashed), "lines")
    counted = docs.withColumn("lines_in", F.size(F.split("body", "\n")))
    once = cut(without_most(counted, cut(later(thin, ["h1", "h2"]), "equal")), "texts")
    lines = places(once).where(F.length("line") >= fuzzy_from).select("rid", "id", "pos", "line", F.xxhash64("line").alias("h1"))
    probes, index = sharing(lines, edits, most, share)
    ends = cut(probes.select(F.col("b").alias("h1")).distinct(), "line-ends")
    shared = cut(sifted(lines, ends), "line-places")
    linked = components(near_lines(shared, probes, index, edits, most, share)).select(F.col("node").alias("h1"), "root")
    drops = cut(later(shared.select("rid", "id", "pos", "h1").join(linked, "h1"), ["root"]), "drops")
    done = without_most(once, drops)
    names = [F.col("body").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    # a text whose lines are all gone is empty and has no line
    out = F.when((F.col("body") == "") & (F.col("lines_in") > 1), F.lit(0)).otherwise(F.size(F.split("body", "\n")))
    return done.select(*names, F.col("lines_in").alias("lines_in"), out.alias("lines_out"))

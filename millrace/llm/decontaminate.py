"""Benchmark decontamination by templates (operator 6).

Texts become template tokens: words are lower-cased and freed of punctuation; numbers, names (capitalised words
that do not begin a sentence) and units (after a number) become typed placeholders, whose values are the slots.
Windows of ``WINDOW`` tokens (a shorter benchmark item is one window) are hashed and hash-joined. A window with
fewer than ``PLAIN`` plain words keeps its values: its template alone says too little and would be very frequent.

An alignment is all shared windows of a document and an item at one offset. Its slots must be consistent: equal
values of the item stand for equal values of the document and the other way round. Windows of inconsistent
alignments do not count. A document leaks an item if ``SHARE`` of the item's windows are found; ``same_values``
says whether an alignment has all slots equal (a copy) or the question is re-parameterised.

Before the join, windows of documents are sifted in the task that reads them by the slots (hash modulo
``SLOTS``) of the benchmark's windows: a bitmap of fixed size, whatever the benchmark's.

Defined results: null texts are empty; items without words leak nowhere. Rows with one id count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches
from millrace.llm.growing import Growing

WINDOW, PLAIN, SHARE, SLOTS = 5, 2, 0.8, 1 << 21
#: Words kept by a worker, texts looked at side by side.
REMEMBERED, TOGETHER = 600_000, 32
#: Units that a number may carry.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal s sec secs min mins h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres mile miles gram grams liter liters litre litres second seconds minute minutes percent dollar dollars euro euros cent cents "
    "kb mb gb tb hz khz mhz ghz w kw v j kj cal kcal c f k % $ € £".split()
)
#: Signs around words; those in INNER may belong to a number or be a unit.
OUTER, INNER = ".,;:!?\"'()[]{}<>*#&|/\\_~`^=@…«»“”‘’¿¡", "$€£%+-"
WORD, NUMBER, NAME, UNIT = range(4)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Templates:
    """Words met so far as numbers, with what each can be."""

    def __init__(self):
        self.number = regex.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
        self.edges = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.values: list[str] = []
        self.told = Growing(np.uint64, bool, bool, bool, bool, bool)  # hash, number, name, unit, ends a sentence, holds anything

    def look_up(self, word: str) -> int:
        core, is_number, ends = word, False, False
        if not word.isalpha():
            core = word.strip(OUTER)
            ends = word == "\x01" or word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
            if not core.isalpha():  # letters alone are no number and have no signs around them
                is_number = self.number.fullmatch(core) is not None
                if not is_number and core not in UNITS:
                    core = core.strip(INNER)
                    if core and not (core[0].isalnum() and core[-1].isalnum()):
                        core = self.edges.sub("", core)
        name = len(core) > 1 and core[0].isupper() and core[1:] != core[1:].upper()
        value = core.lower()
        self.values.append(value)
        self.known[word] = self.told.add(xxhash.xxh64_intdigest(value.encode()), is_number, name, value in UNITS, ends, value != "")
        return len(self.values) - 1

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the word, kind and hash of each token of all texts, and the bounds of the texts."""
        if len(self.values) >= REMEMBERED:
            self.clear()
        known, split = self.known, [text.replace("\n", " \x01 ").split() for text in texts]
        get, add = known.get, self.look_up
        at = np.array([i if (i := get(w)) is not None else add(w) for words in split for w in words], np.int64)
        bounds = np.append(0, np.cumsum([len(words) for words in split])).astype(np.int64)
        hashes, number, name, unit, ends, full = (a[at] for a in self.told.read())
        # texts lie side by side: the first word of each begins a sentence and follows no number
        begins = np.append(True, ends[:-1])[: len(at)]
        begins[bounds[:-1][bounds[:-1] < len(at)]] = True
        begins = self.carry(begins, full)
        bounds = np.append(0, np.cumsum(full))[bounds]
        at, hashes, number, name, unit, begins = (x[full] for x in (at, hashes, number, name, unit, begins))
        after = np.append(False, number[:-1])[: len(at)]
        after[bounds[:-1][bounds[:-1] < len(at)]] = False
        kind = np.where(number, NUMBER, np.where(unit & after, UNIT, np.where(name & ~begins, NAME, WORD)))
        return at, kind, hashes, bounds

    @staticmethod
    def carry(begins: np.ndarray, full: np.ndarray) -> np.ndarray:
        """A token begins a sentence if one ended anywhere since the last full token."""
        ended = np.cumsum(begins)
        before = np.zeros(len(full), np.int64)
        places = np.flatnonzero(full)
        before[places[1:]] = ended[places[:-1]] if len(places) else 0
        return ended > before

    @staticmethod
    def windows(kind: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of the tokens."""
        n = len(kind) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        word = kind == WORD
        typed = np.where(word, hashes, mixed(kind.astype(np.uint64) + ODD))
        plain = np.add.reduce([word[k : k + n] for k in range(width)], dtype=np.int8)
        out = [np.full(n, width, np.uint64) for _ in range(2)]
        for k in range(width):
            out = [mixed(h * ODD + x[k : k + n]) for h, x in zip(out, (typed, hashes), strict=True)]
        return np.where(plain >= min(PLAIN, width), out[0], out[1])

    def slots(self, at: np.ndarray, kind: np.ndarray, first: int, width: int) -> list[str]:
        """offset:kind:value of the placeholders of a window."""
        return [f"{k}:{kind[first + k]}:{self.values[at[first + k]]}" for k in range(width) if kind[first + k] != WORD]


#: The words that a worker keeps from task to task.
KEPT: list[Templates] = []


def windows_of(df: DataFrame, key: Column, text: Column, widths: list[int] | None, bitmap: bytes | None) -> DataFrame:
    """key, hash, pos, slots, total of windows: of the benchmark (``widths`` None), or of documents in the bitmap's slots."""
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()
    shared = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        if not KEPT:
            KEPT.append(Templates())
        own = KEPT[0]
        wanted = None if shared is None else np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)

        def step(keys: list, texts: list) -> tuple:
            rows, hashes, places, slots, totals = [], [], [], [], []
            for first in range(0, len(texts), TOGETHER):
                at, kinds, known, bounds = own.tokens(texts[first : first + TOGETHER])
                sizes = np.diff(bounds)
                marked = np.append(0, np.cumsum(kinds != WORD))
                for width in widths or range(1, WINDOW + 1):
                    h = own.windows(kinds, known, width)
                    hit = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted[(h % np.uint64(SLOTS)).astype(np.int64)])
                    text = np.searchsorted(bounds, hit, "right") - 1
                    # a window ends inside its text; an item has windows of one width
                    inside = hit + width <= bounds[text + 1]
                    if widths is None:
                        inside &= np.minimum(WINDOW, sizes[text]) == width
                    hit, text = hit[inside], text[inside]
                    if not len(hit):
                        continue
                    filled = marked[hit + width] > marked[hit]
                    rows += (first + text).tolist()
                    hashes.append(h[hit])
                    places.append((hit - bounds[text]) * 8 + width)
                    totals += (sizes[text] - width + 1).tolist()
                    slots += [own.slots(at, kinds, i, width) if f else [] for i, f in zip(hit.tolist(), filled.tolist(), strict=True)]
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            return [keys[k] for k in rows], pa.array(flat), pa.array(place // 8), pa.array((place % 8).astype(np.int32)), slots, totals

        return step

    columns = [key.alias("key"), F.coalesce(text, F.lit("")).alias("text")]
    return map_batches(df, columns, make, f"key {kind}, hash long, pos long, width int, slots array<string>, total long")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """key, item, covered (share of the item's windows), same_values and distinct_values, a row for each leaking document and item.

    distinct_values tells whether different values of the item stay different in the document.
    """
    items = windows_of(benchmark, F.col(item), F.col(item_text), None, None)
    items = items.select(F.col("key").alias("item"), "hash", F.col("pos").alias("item_pos"), F.col("width"), F.col("slots").alias("item_slots"), "total").dropDuplicates(["item", "item_pos", "hash"])
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WINDOW
    used = items.select(F.pmod("hash", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)  # at most SLOTS
    bits = np.zeros(SLOTS, bool)
    bits[used] = True
    found = windows_of(docs, F.col(key), F.col(text), widths, np.packbits(bits).tobytes())
    hits = found.select(F.col("key").alias("doc"), "hash", "pos", F.col("slots").alias("doc_slots"), "width").join(items, ["hash", "width"])
    pairs = F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(F.regexp_replace(a, "^[0-9]+:", "").alias("a"), F.regexp_replace(b, "^[0-9]+:", "").alias("b")))
    # a place of the item meets one place of the document in an alignment: sets are no larger than the item
    aligned = hits.groupBy("doc", "item", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.max("total").alias("total")
    )
    sides = [F.size(F.array_distinct(F.transform("pairs", lambda p: p[s]))) for s in "ab"]
    # a value of the item has one value in the document; two of the item may have the same one there
    steady = aligned.where(sides[0] == F.size("pairs"))
    told = [(~F.exists("pairs", lambda p: p["a"] != p["b"])).alias("same"), (sides[1] == F.size("pairs")).alias("apart")]
    counted = steady.select("doc", "item", "total", *told, F.explode("places").alias("place"))
    each = counted.groupBy("doc", "item", "place").agg(F.max("same").alias("same"), F.max("apart").alias("apart"), F.max("total").alias("total"))
    joined = each.groupBy("doc", "item").agg(
        F.count("*").alias("n"), F.max("total").alias("total"), F.min("same").alias("same_values"), F.min("apart").alias("distinct_values"))
    return joined.where(F.col("n") >= SHARE * F.col("total")).select(
        F.col("doc").alias(key), F.col("item").alias(item), (F.col("n") / F.col("total")).alias("covered"), "same_values", "distinct_values"
    )

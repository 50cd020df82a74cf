"""Near-duplicate detection with SuperMinHash, banding, verification and union-find.

Documents with equal sets of shingles form a class and go on as their smallest id: those of equal
fingerprints (number and two 64-bit sums of hashes) whose texts are equal, too, or whose
full sets are confirmed to be equal. A class's
signature has ``SLOTS`` values; every ``ROWS`` of them are a band, and classes that agree on a band
share a bucket. Two classes of similarity 0.75 share none of 32 bands of 4 rows with a
probability of 5 in a million.

In each bucket every class is compared with the smallest first, which connects most groups of
copies in one round, whatever their size. Only where a bucket still holds several components
are further pairs compared, those whose signatures agree best first, until all pairs of
different components that share a bucket and whose signatures don't rule them out have
been compared. Links are confirmed on the full sets of both texts; where one text has many
partners, copies of it meet a bounded number of them each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.arrow import binary_views, bound_batches, held, map_texts, release, slices
from corpusmill.llm.components import components
from corpusmill.llm.skew import FEW_GROUPS, join_groups
from corpusmill.sources.tables import materialise, read_table

WORDS, PERCENT = 5, 75
WORD = r"[^\x20\x09-\x0D]"
SLOTS, ROWS = 128, 4
#: Pairs whose signatures agree on less than this share aren't compared: over 4.5 standard
#: deviations below 0.75.
LEAST_AGREEMENT = 0.575
#: Classes of a bucket that are compared in one group; larger buckets are cut into tiles.
TILE = 4096
#: Partners of a class that are compared in the first round, in a bucket; each later round takes 8 times more.
PARTNERS = 4
#: Hashes of a sketch; a set up to that size is whole in its sketch.
SKETCH = 2048
#: Ids that are broadcast to pick out texts, at most; beyond, they are shuffled.
FEW_IDS = 500_000
#: Pairs that one copy of a text meets, about.
SPREAD = 256
#: Elements whose permutations are held at once, and cached words.
ELEMENTS, CACHED = 1 << 16, 1 << 17

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED and len(word) <= 64:
            self[word] = made
        return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("words", _Hashes).__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mix((h * _FACTORS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * _FACTORS[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _FACTORS[k]
    return np.unique(mix(total))


def _draws(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Round j of each element: its value, and its place among the slots from j on."""
    x = mix(elements + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(32)) | np.uint64(j << 32), j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (rows) of non-empty sets.

    An element visits the slots in an order of its own, with rising values: in round j a
    random value plus j at the j-th slot of its permutation. A slot keeps its least value. After
    round j a set whose slots are all below j + 1 is done, for later rounds bring more.
    """
    n = np.array([len(s) for s in sets])
    best = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    elements, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    value, place = _draws(elements, 0)
    np.minimum.at(best.ravel(), of * SLOTS + place, value)
    left = np.flatnonzero((best >> np.uint64(32) >= 1).any(1))
    while len(left):
        took = max(1, int(np.searchsorted(np.cumsum(n[left]), ELEMENTS, "right")))
        _later_rounds(best, left[:took], sets)
        left = left[took:]
    low, high = best & np.uint64(0xFFFFFFFF), best >> np.uint64(32)
    return (low ^ (high * np.uint64(0x9E3779B1))).astype(np.uint32)


def _later_rounds(best: np.ndarray, which: np.ndarray, sets: list[np.ndarray]) -> None:
    elements = np.concatenate([sets[i] for i in which])
    of = np.repeat(which, [len(sets[i]) for i in which])
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
    rows = np.arange(len(elements))
    for j in range(SLOTS):
        value, k = _draws(elements, j)
        slot = order[rows, k]
        order[rows, k] = order[:, j]
        order[:, j] = slot
        if j:
            np.minimum.at(best.ravel(), of * SLOTS + slot, value)
            done = (best[which] >> np.uint64(32) <= j).all(1)
            if done.all():
                return
            if done.any():
                which = which[~done]
                stay = np.isin(of, which)
                elements, of, order = elements[stay], of[stay], order[stay]
                rows = np.arange(len(elements))


def _describe(texts: list[str | None]) -> dict[str, list]:
    sets = [shingle_set(t) for t in texts]
    some = [i for i, s in enumerate(sets) if len(s)]
    sig: list[bytes | None] = [None] * len(sets)
    if some:
        for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
            sig[i] = row.tobytes()
    total = lambda s: int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
    return {"n": [len(s) for s in sets], "high": [total(s) for s in sets], "low": [total(mix(s ^ _GOLD)) for s in sets], "sig": sig}


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts' sets are similar enough; ``equal`` says that they are the same."""
    last: tuple[int, str | None] | None = None
    x = np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text_a"):
            keep, equal = [], []
            ids = part.column("a").to_pylist()
            for i, a, ta, tb in zip(range(len(ids)), ids, part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                if last != (a, ta):  # pairs of one class come together
                    last, x = (a, ta), shingle_set(ta)
                y = shingle_set(tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    keep.append(i)
                    equal.append(common == len(x) == len(y))
            kept = part.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(equal, pa.bool_())], names=["a", "b", "equal"])
    release()


def _copies(pairs: DataFrame, side: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with the number of the copy of text ``side`` that each meets, and how many copies texts of many pairs have."""
    counted = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SPREAD)
    many = materialise(counted.withColumn("__parts", F.ceil(F.col("__n") / SPREAD).cast("int")), "spread")
    dealt = join_groups(pairs, many, [side], "__n", total, "left", many.count())
    number = F.pmod(F.xxhash64("a", "b"), F.coalesce("__parts", F.lit(1))).cast("int")
    return dealt.withColumn(f"__at_{side}", number).drop("__n", "__parts"), many.select(F.col(side).alias("id"), "__parts")


def _confirmed(pairs: DataFrame, docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of a written table whose texts are similar enough, and whether their sets are equal.

    Each side's texts are those of its own ids. Up to FEW_GROUPS pairs come to the texts b, which stay; with them they go to the texts a.
    """
    total = pairs.count()
    dealt, many_a = _copies(pairs, "a", total)
    dealt, many_b = _copies(dealt, "b", total)
    rows = materialise(dealt, "dealt")
    rows = F.broadcast(rows) if total <= FEW_GROUPS else rows
    for side, many in (("b", many_b), ("a", many_a)):
        texts = _texts_of(materialise(pairs.select(F.col(side).alias("id")).distinct(), "wanted"), docs, shared)
        numbers = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
        copies = texts.join(many, "id", "left").select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"), F.explode(numbers).alias(f"__at_{side}"))
        rows = rows.join(copies, [side, f"__at_{side}"])
    return rows.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_verify, "a long, b long, equal boolean").distinct()


def _sketches(texts: list[str | None]) -> dict[str, list]:
    """The upper halves of each set's smallest hashes."""
    return {"sketch": [(shingle_set(t)[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for t in texts]}


def _may_link(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    """Whether two sketches leave room for a link.

    Whole sets are compared as they are, with one for the rare halves that coincide; of larger ones the smallest hashes of
    the union are a random sample, whose agreement must lie within 4.5 standard deviations.
    """
    if n_x <= SKETCH and n_y <= SKETCH:
        common = len(np.intersect1d(x, y)) + 1
        return 100 * common >= PERCENT * (n_x + n_y - common)
    union = np.union1d(x, y)[:SKETCH]
    both = np.isin(union, x) & np.isin(union, y)
    return both.mean() >= PERCENT / 100 - 4.5 * (0.1875 / len(union)) ** 0.5


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table), to be broadcast up to ``FEW_IDS`` of them."""
    return F.broadcast(rows) if rows.count() <= FEW_IDS else rows


def _one_each(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """One of the rows of each id; only those of the ids ``shared`` (a written table, or none), which several rows have, are shuffled, if these are few."""
    if shared is None:
        return rows
    if shared.count() > FEW_IDS:
        return rows.dropDuplicates(["id"])
    again = F.broadcast(shared)
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").dropDuplicates(["id"]))


def _texts_of(ids: DataFrame, docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """id and text of the documents in ``ids`` (a written table, id), once each."""
    return _one_each(docs.join(_few(ids), "id", "left_semi"), shared)


def _pairs_in(bands: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, shared: DataFrame | None, most: int, number: int) -> DataFrame:
    """Pairs (a, b, key, cut) of classes of different components that share a bucket and may be similar.

    A pair is found in the first of the bands that it shares and in no other, and by a class that
    isn't of the bucket's commonest component. There are ``number`` buckets at most. Signatures, then sketches rule out what can't be a
    link. Each such class gets ``most`` partners, those whose signatures agree best first, in each
    tile; ``cut`` says that it had more.
    """
    now = bands.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows")).where("x < y AND rows > 2")
    total = bands.count()
    inside = join_groups(now, mixed.drop("x", "y"), ["key"], "rows", total, number=number)
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    inside = inside.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # A row goes to every tile (own, other) and (other, own): all pairs of a bucket meet once.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = inside.withColumn("other", other).select("key", "band", "id", "component", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    ids = materialise(inside.select("id").distinct(), "mixed")
    sketches = map_texts(_texts_of(ids, docs, shared), "text", _sketches, "sketch binary")
    described = classes.join(_few(ids), "id", "left_semi").select("id", "n", "sig").join(sketches, "id")
    rows = dealt.join(described, "id")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        name, band, p, q = (k.as_py() for k in key)
        ids, part = (table.column(c).to_numpy() for c in ("id", "component"))
        own, size = table.column("own").to_numpy(), table.column("n").to_numpy()
        sig = np.array(binary_views(table.column("sig"), np.uint32)).reshape(-1, SLOTS)
        sketch = binary_views(table.column("sketch"), np.uint32)
        kinds, counts = np.unique(part, return_counts=True)
        found: dict[tuple[int, int], bool] = {}
        for i in np.flatnonzero(part != kinds[counts.argmax()]):
            js = np.flatnonzero((part != part[i]) & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])))
            if p != q:
                js = js[own[js] != own[i]]
            same = sig[js] == sig[i]
            first = same.reshape(len(js), SLOTS // ROWS, ROWS).all(2).argmax(1) == band
            agree = same.mean(1)
            js, agree = js[first & (agree >= LEAST_AGREEMENT)], agree[first & (agree >= LEAST_AGREEMENT)]
            taken = 0
            for j in js[np.lexsort((ids[js], -agree))]:
                if _may_link(sketch[i], sketch[j], size[i], size[j]):
                    taken += 1
                    if taken > most:  # the last pair says that there are more
                        found[pair] = True
                        break
                    pair = (int(min(ids[i], ids[j])), int(max(ids[i], ids[j])))
                    found.setdefault(pair, False)
        a, b = zip(*found, strict=True) if found else ((), ())
        del sig, sketch, table
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "key": pa.array([name] * len(a), pa.int64()), "cut": pa.array(list(found.values()), pa.bool_())})

    return rows.groupBy("key", "band", "p", "q").applyInArrow(compare, "a long, b long, key long, cut boolean")


def _nodes(described: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Number each text of an id: rows (id, n, high, low, sig, digest), rows (id, text), links between an id's texts, and the numbers that several rows have.

    An id's first text, by digest, goes by the id itself and each other one by a number beyond all
    ids. Rows without a word are left out. What no id asks for is None.
    """
    some = described.where("n > 0 AND id IS NOT NULL")
    texts = rows.where(F.col("id").isNotNull() & F.regexp_like("text", F.lit(WORD)))
    several = some.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = materialise(several.select("id", "lo", "hi"), "several")
    if several.isEmpty():
        return some, texts.select("id", "text"), None, None
    first = several.where("lo <> hi").select("id", "lo")
    if first.isEmpty():
        return some, texts.select("id", "text"), None, several.select("id")
    other = some.join(_few(first), "id").where("digest <> lo").select("id", "digest").distinct()
    beyond = described.agg(F.max("id")).first()[0] + 1  # beyond those of blank texts as well
    other = materialise(other.withColumn("node", F.lit(beyond) + F.monotonically_increasing_id()), "nodes")
    number = lambda df: df.join(_few(other), ["id", "digest"], "left").withColumn("id", F.coalesce("node", "id")).drop("node")
    shared = materialise(number(some).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "shared")
    return number(some), number(texts).select("id", "text"), other.select(F.col("id").alias("a"), F.col("node").alias("b")), shared


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the rows of ``docs`` whose shingle sets are similar, directly or through others.

    Returns one row for each row of ``docs``: doc_id, n_shingles, component_id, kept. A null or
    blank text has no shingles and is linked with nothing; so is a row with a null id, which
    has a null component_id and is kept. Rows that share an id are one document, linked by
    whichever of its texts, and in one component, so all are kept or none. Texts are taken whole. An empty table gives an empty result;
    other columns of ``docs`` are not read. Ids are integers under 2^62.
    """
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    described = materialise(map_texts(rows, "text", _describe, "n long, high long, low long, sig binary"), "signatures")
    some, texts, links, shared = _nodes(described, rows)

    # Classes of equal sets
    same = ["high", "low", "n"]
    groups = some.groupBy(*same).agg(F.min(F.struct("id", "digest")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = materialise(groups.select(*same, F.col("c.id").alias("class"), F.col("c.digest").alias("first"), "members"), "classes")
    total = described.count()
    member_of = join_groups(some.select("id", "digest", *same), groups, same, "members", total, number=groups.count())
    member_of = materialise(member_of.where("id > class").select("id", "class", (F.col("digest") == F.col("first")).alias("copy")).distinct(), "members")
    alike = materialise(member_of.where("NOT copy").select(F.col("class").alias("a"), F.col("id").alias("b")), "pairs")
    later = member_of.where("copy").select("id", "class")
    if not alike.isEmpty():
        equal = _confirmed(alike, texts, shared).where("equal").select(F.col("b").alias("id"), F.col("a").alias("class"))
        later = later.unionByName(materialise(equal, "confirmed"))
    classes = _one_each(some.join(_few(materialise(later.select("id"), "later")), "id", "left_anti").select("id", "n", "sig"), shared)
    classes = materialise(classes, "class-signatures")

    # Buckets of two or more
    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.substring("sig", 1 + width * i, width), F.lit(i)) for i in range(SLOTS // ROWS)))
    every = classes.select("id", F.posexplode(keys).alias("band", "key"))
    buckets = every.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    buckets = materialise(buckets, "buckets")
    bands = materialise(join_groups(every, buckets, ["key"], "rows", SLOTS // ROWS * total, number=(number := buckets.count())).select("key", "band", "id", "lead"), "bands")

    # Every class of a bucket against the smallest
    pairs = bands.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialise(pairs, "pairs")
    confirmed = materialise(_confirmed(tested, texts, shared), "confirmed").select("a", "b")
    links = confirmed if links is None else confirmed.unionByName(_by_class(links, later))
    labels = components(links)
    most, open_bands = PARTNERS, bands.select("key", "band", "id")
    while True:
        found = materialise(_pairs_in(open_bands, classes, labels, texts, shared, most, number), "pairs")
        cut = found.where("cut").select("key").distinct()
        more = materialise(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            new = materialise(_confirmed(more, texts, shared), "confirmed")
            if not new.isEmpty():
                stars = labels.select(F.col("component").alias("a"), F.col("id").alias("b"))
                labels = components(stars.unionByName(new.select("a", "b")))
            tested = tested.unionByName(more)
        if cut.isEmpty():  # all pairs that were left have been compared
            break
        # In the other buckets every pair has been compared.
        open_bands = materialise(open_bands.join(cut, "key", "left_semi"), "bands")
        most *= 8

    # Back to documents
    label = later.withColumnRenamed("class", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    label = label.unionByName(labels.select("id", F.col("component").alias("component_id"))).groupBy("id").agg(F.min("component_id").alias("component_id"))
    label = _few(materialise(label, "labels"))
    out = described.select("id", "n").join(label, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _by_class(links: DataFrame, later: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids."""
    for side in ("a", "b"):
        links = links.join(later.select(F.col("id").alias(side), "class"), side, "left").withColumn(side, F.coalesce("class", side)).drop("class")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps."""
    gone = materialise(near_duplicates(docs, id_col, text_col).where("NOT kept").select("doc_id").distinct(), "dropped")
    key = F.col(id_col).cast("long") == F.col("__near_gone")
    return docs.join(_few(gone.select(F.col("doc_id").alias("__near_gone"))), key, "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
SQL: dict[str, str] = {}

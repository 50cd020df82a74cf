"""Mining of collocations by contiguous pattern growth.

Frequent words are counted first. Each occurrence of a frequent word then becomes a pointer to
what follows it inside its piece, up to the longest phrase and only as far as words are frequent;
equal pointers are counted where they lie. All pointers of one word, its projection, meet in one
task, which extends the word to the right depth-first: the pointers of an extension that occurs
often enough are projected again, those of all others are left.

A word with more than ``SALT_ROWS`` occurrences has its pointers dealt over salts by what they point to, so
that no task holds more; a longest phrase is then still counted in one task, and shorter ones are
summed afterwards. Which words are frequent, and how many salts they have, tasks read from a table of hash
slots of bounded size: words that share a slot cost pointers that come to nothing, but change no count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.arrow import bound_batches, release, slices
from corpusmill.llm.skew import join_groups
from corpusmill.sources.tables import materialise, read_table

LEAST, LONGEST, SHARE, BEST = 10, 3, 50, 2000
#: Occurrences of a word beyond which its pointers are dealt over salts.
SALT_ROWS = 1 << 19
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Hash slots, at least and at most, and those of one block of the table.
FEWEST_SLOTS, MOST_SLOTS, BLOCK_SLOTS = 1 << 16, 1 << 25, 1 << 16
#: The score of a cut; its products may pass 64 bits.
SCORE = "(CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
#: Pieces end at the first group of bytes; a piece's words are parted by spaces and tabs.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def _pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece, A-Z lower-cased."""
    return [words for p in (text or b"").lower().translate(_ENDS).split(b"\n") if (words := p.split())]


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.DictionaryArray]]:
    """For each language of a few documents: all words, with a null after each piece."""
    words: dict[str, list] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        mine = words.setdefault(lang, [])
        for piece in _pieces(text):
            mine += piece
            mine.append(None)
    for lang, all_words in words.items():
        yield lang, pa.array(all_words, pa.binary()).dictionary_encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n), and with a null word the number of all words."""
    counts: dict[tuple[str, bytes | None], int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, stream in _streams(part):
                times = np.bincount(stream.indices.drop_null().to_numpy(), minlength=len(stream.dictionary))
                for word, n in zip(stream.dictionary.to_pylist(), times.tolist(), strict=True):
                    counts[lang, word] = counts.get((lang, word), 0) + n
                counts[lang, None] = counts.get((lang, None), 0) + int(times.sum())
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()
    release()


def _slot_table(words: DataFrame, salt_rows: int) -> np.ndarray:
    """For each hash slot 0, or 1 and the base-2 logarithm of the salts of its most frequent word."""
    spark, many = words.sparkSession, words.count()
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (16 * many).bit_length()))
    slot = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.col("word"))).bitwiseAND(F.lit(slots - 1))
    level = F.lit(1) + F.ceil(F.log2(F.greatest(F.col("n") / salt_rows, F.lit(1.0)))).cast("int")
    levels = words.select(slot.alias("slot"), level.alias("level")).groupBy("slot").agg(F.max("level").alias("level"))
    dealt = levels.withColumn("block", F.expr(f"slot div {BLOCK_SLOTS}")).repartition("block").sortWithinPartitions("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = [None, None]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([done[0]], pa.int64()), pa.array([done[1].tobytes()], pa.binary())], names=["block", "levels"])
        for batch in batches:
            block, slot_, level_ = (batch.column(c).to_numpy() for c in ("block", "slot", "level"))
            for b in np.unique(block).tolist():
                if b != done[0]:
                    if done[0] is not None:
                        yield row()
                    done = [b, np.zeros(BLOCK_SLOTS, np.uint8)]
                done[1][slot_[block == b] % BLOCK_SLOTS] = level_[block == b]
        if done[0] is not None:
            yield row()

    table = np.zeros(slots, np.uint8)
    for r in dealt.mapInArrow(pack, "block long, levels binary").collect():
        table[r.block * BLOCK_SLOTS : (r.block + 1) * BLOCK_SLOTS] = np.frombuffer(r.levels, np.uint8)
    return table


def _project(lang: str, stream: pa.DictionaryArray, table: np.ndarray, longest: int) -> pa.RecordBatch:
    """A row for each frequent word (and salt) of the stream: the distinct pointers of its occurrences, with their numbers."""
    words = stream.dictionary
    start = zlib.crc32(lang.encode() + b"\0")
    hashes = np.array([zlib.crc32(w, start) for w in words.to_pylist()], np.int64)
    level = np.append(table[hashes & (len(table) - 1)], 0)
    code = stream.indices.fill_null(len(words)).to_numpy().astype(np.int64)
    code[level[code] == 0] = len(words)  # the end of a piece, or a word that isn't frequent
    none, n = len(words), len(code)
    path = np.full((longest, n), none)
    path[0] = code
    for k in range(1, longest):
        path[k, : n - k] = np.where(path[k - 1, : n - k] == none, none, code[k:])
    path = path[:, (path[0] != none) & (path[1] != none)]
    # Equal pointers stand together after the sort by all words of their paths.
    path = path[:, np.lexsort(path[::-1])]
    first = np.append(True, (path[:, 1:] != path[:, :-1]).any(0))[: path.shape[1]]
    at = np.flatnonzero(first)
    times, path = np.diff(np.append(at, path.shape[1])), path[:, at]
    mixed = np.zeros(path.shape[1], np.int64)
    for row in path[1:]:
        mixed = (mixed * 1_000_003 + np.append(hashes, 0)[row]) & 0x7FFFFFFF
    salt = (mixed ^ (mixed >> 15)) & ((1 << np.maximum(level[path[0]].astype(np.int64) - 1, 0)) - 1)
    order = np.lexsort((salt, path[0]))
    path, times, salt = path[:, order], times[order], salt[order]
    new = np.flatnonzero(np.append(True, (path[0, 1:] != path[0, :-1]) | (salt[1:] != salt[:-1]))[: path.shape[1]])
    ends = np.append(new, path.shape[1])
    tails = words.take(pa.array(path[1]))
    for row in path[2:]:
        more = words.take(pa.array(row, mask=row == none))
        tails = pc.if_else(pc.is_null(more), tails, pc.binary_join_element_wise(tails, more, b" ", null_handling="replace"))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails)
    counts = times.astype("<i8")
    columns = [
        pa.array([lang] * len(new), pa.string()), words.take(pa.array(path[0, new])), pa.array(salt[new]), pa.array(level[path[0, new]] > 1),
        pc.binary_join(lists, b"\n"), pa.array([counts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "salt", "salted", "tails", "times"])


def extend(prefix: tuple[bytes, ...], tails: dict[bytes, int], least: int, longest: int, partial: bool) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The phrases that grow from ``prefix`` to the right, depth-first, with their numbers.

    ``tails`` are the prefix's pointers: what follows it, with how often it does. With ``partial`` they aren't
    all there are, so that only the longest phrases are known to be rare.
    """
    heads: dict[bytes, dict[bytes, int]] = {}
    for tail, n in tails.items():
        head, _, rest = tail.partition(b" ")
        mine = heads.setdefault(head, {})
        mine[rest] = mine.get(rest, 0) + n
    for head, rests in heads.items():
        phrase, n = (*prefix, head), sum(rests.values())
        deepest = len(phrase) == longest
        if n < least and (deepest or not partial):
            continue
        yield phrase, n
        rests.pop(b"", None)
        if rests and not deepest:
            yield from extend(phrase, rests, least, longest, partial)


def _grow(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The phrases of each word; a word's rows (of one salt) follow each other."""
    key: tuple | None = None
    tails: dict[bytes, int] = {}
    out: list[tuple[str, tuple[bytes, ...], int]] = []

    def rows() -> pa.RecordBatch:
        columns = [pa.array([o[0] for o in out], pa.string()), pa.array([b" ".join(o[1]) for o in out], pa.binary()), pa.array([len(o[1]) for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64())]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])

    def finish() -> None:
        if key is not None:
            out.extend((key[0], p, n) for p, n in extend((key[1],), tails, least, longest, key[3]))

    for batch in batches:
        for *mine, payload, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "salt", "salted", "tails", "times")), strict=True):
            if tuple(mine) != key:
                finish()
                key, tails = tuple(mine), {}
                if len(out) > 50_000:
                    yield rows()
            for tail, n in zip(payload.split(b"\n"), np.frombuffer(times, "<i8").tolist(), strict=True):
                tails[tail] = tails.get(tail, 0) + n
    finish()
    yield rows()
    release()


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, salt_rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words (one at least) found ``least`` times in a language, and the words of each language.

    The first table has lang, phrase (words parted by one space), size (in words) and n; the
    second lang and n, the number of all words. Null languages are ``und``, null texts empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    bound_batches(spark)
    counted = rows.mapInArrow(_count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(counted.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    frequent = words.where(F.col("word").isNotNull())
    single = frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("size"), "n")
    totals = words.where(F.col("word").isNull()).select("lang", "n")
    if longest < 2:
        return single, totals
    shipped = spark.sparkContext.broadcast(_slot_table(frequent, salt_rows).tobytes())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, stream in _streams(part):
                    yield _project(lang, stream, table, longest)
        release()

    projected = rows.mapInArrow(project, "lang string, word binary, salt long, salted boolean, tails binary, times binary")
    dealt = projected.repartition("lang", "word", "salt").sortWithinPartitions("lang", "word", "salt")
    grown = dealt.mapInArrow(lambda b: _grow(b, least, longest), "lang string, phrase binary, size int, n long")
    found = grown.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    longer = materialise(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "n"), "phrases")
    return single.unionByName(longer), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, best: int = BEST, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``longest`` words and at least ``least`` occurrences (a). A phrase cut in two has
    l and r, the occurrences of its parts, and the score floor(1000000 * a * a / (l * r)), exact;
    its lowest-scoring cut counts, the first of equal ones. A phrase within a longer one that
    has ``share`` per cent of its occurrences or more is left out. n counts a language's words. Order: score
    and a descending, then the phrase by bytes.

    A null language is ``und``, a null text empty; repeated rows and null ids count like any other. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least, longest, salt_rows)
    total = phrases.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = F.split("phrase", " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        parts = phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
        cuts = join_groups(cuts, parts, ["lang", side], n, total)
    scored = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    spans = candidates.where("size > 2").select("lang", "words", "size", "a", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    spans = spans.select("lang", "words", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
    within = spans.select("lang", F.expr("array_join(slice(words, at, m), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * cut.a").select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations(read_table(spark, sf_dir, "documents", "lang", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS MATERIALIZED (
  SELECT row_number() OVER () AS piece, lang, p FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)
), w AS MATERIALIZED (
  SELECT piece, lang, w, i FROM (SELECT piece, lang, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT piece, lang, string_split_regex(p, '[ \t]+') AS x FROM p)) WHERE w <> ''
), g AS MATERIALIZED (
  SELECT lang, w AS x, lead(w) OVER o AS y, lead(w, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)
), f1 AS MATERIALIZED (SELECT lang, x, count(*) AS n FROM g GROUP BY lang, x),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS n FROM g WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS n FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
longer AS MATERIALIZED (
  SELECT lang, x, y, max(n) AS most FROM (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) AS t GROUP BY lang, x, y
), s2 AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.n AS a, l.n AS l, r.n AS r, (1000000 * (c.n::HUGEINT * c.n)) // (l.n::HUGEINT * r.n) AS score
  FROM f2 AS c JOIN f1 AS l ON l.lang = c.lang AND l.x = c.x JOIN f1 AS r ON r.lang = c.lang AND r.x = c.y
  LEFT JOIN longer AS t ON t.lang = c.lang AND t.x = c.x AND t.y = c.y WHERE t.most IS NULL OR 100 * t.most < 50 * c.n
), cut3 AS (
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.n AS a, l1.n AS l1, r1.n AS r1, l2.n AS l2, r2.n AS r2,
         (1000000 * (c.n::HUGEINT * c.n)) // (l1.n::HUGEINT * r1.n) AS s1, (1000000 * (c.n::HUGEINT * c.n)) // (l2.n::HUGEINT * r2.n) AS s2
  FROM f3 AS c JOIN f1 AS l1 ON l1.lang = c.lang AND l1.x = c.x JOIN f2 AS r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z
  JOIN f2 AS l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 AS r2 ON r2.lang = c.lang AND r2.x = c.z
), kept AS (
  SELECT lang, phrase, a, l, r, score FROM s2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut3
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
FROM ranked AS k JOIN (SELECT lang, count(*) AS n FROM w GROUP BY lang) AS t ON t.lang = k.lang WHERE k.rank <= 2000
"""

QUERIES = {"op13_phrases": op13_phrases}
SQL = {"op13_phrases": OP13_SQL}

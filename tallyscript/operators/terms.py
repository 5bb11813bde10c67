"""Key-term matching: all occurrences of the terms of vocabularies among token sequences.

The automaton of a sequential scan becomes an equality join: the token windows of each length that some term has are
exploded and joined with the terms' token arrays. The terms are sent to each task only where Spark's own size check
says so. All matches of an example come together in one row, so what is done with them needs no further shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In how many places a single token is met.
SHARES = 16
#: The sieve of windows has at most two to this power words of 64 bits.
SIEVE_BITS = 20


def _capitalized(tokens):
    first = F.get(tokens, F.lit(0))
    return F.concat(F.array(F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 2_000_000_000)))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))


def patterns(vocab: DataFrame, add_capitalized: bool = False) -> DataFrame:
    """vocab (vocab, term, toks array<string>) as distinct patterns (vocab, toks, n); empty ones never match."""
    rows = vocab.select("vocab", "toks").where(F.size("toks") > 0)
    if add_capitalized:
        rows = rows.unionByName(rows.select("vocab", _capitalized(F.col("toks")).alias("toks")))
    return rows.distinct().withColumn("n", F.size("toks"))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """In which word of a table of two to the power of `bits` a hash has its bit, and the bit."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64), np.left_shift(np.uint64(1), mixed & np.uint64(63))


def _rolled(flat: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n neighbours, of the neighbours' hashes."""
    out = flat[: len(flat) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x100000001B3)
        out += flat[k : len(flat) - n + 1 + k]
    return out


def _hashed(toks):
    return F.transform(toks, lambda t: F.xxhash64(t))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements' hashes, and where each list begins and ends."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), ends - sizes, ends


def _sieve(terms: DataFrame, bits: int) -> np.ndarray:
    """The bits of all terms' hashes, some 64 for a term, as a table of bounded size."""

    def ones(batches):
        for batch in batches:
            flat, begin, end = _flat(batch.column(0))
            word, bit = _places(np.array([_rolled(flat[s:e], e - s)[0] for s, e in zip(begin, end, strict=True)], np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    rows = terms.select(_hashed(F.col("toks")).alias("h")).mapInArrow(ones, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << bits, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _sifted(bits: int, sizes: list[int], sent):
    """Of an array of tokens' hashes the runs of some sizes whose hash the table `sent` to all tasks has, as array<struct<s, n>>."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<struct<s:int,n:int>>")
    def runs(lists: pa.Array) -> pa.Array:
        table = sent.value
        flat, begin, end = _flat(lists)
        row, first, long = [], [], []
        owner, stop = np.repeat(np.arange(len(begin)), end - begin), np.repeat(end, end - begin)
        for n in sizes:
            if len(flat) < n:
                continue
            word, bit = _places(_rolled(flat, n), bits)
            at = np.flatnonzero((table[word] & bit) != 0)
            at = at[at + n <= stop[at]]
            row.append(owner[at])
            first.append(at - begin[owner[at]])
            long.append(np.full(len(at), n))
        row, first, long = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (row, first, long))
        order = np.argsort(row, kind="stable")
        made = pa.StructArray.from_arrays([pa.array(first[order], pa.int32()), pa.array(long[order], pa.int32())], ["s", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(begin)))]), pa.int32()), made)

    return runs


def occurrences(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """tokens (ex_id, side, toks) and patterns: (ex_id, side, vocab, s, e, toks) of all occurrences, overlapping ones too.

    Nearly all windows of several tokens are no term: those whose hash no term has are never made. Single tokens often
    are one, and some of these are very frequent, so each of them is met in SHARES places.
    """
    counted = {r["n"]: r["count"] for r in terms.groupBy("n").count().collect()}
    lengths = sorted(counted)
    spark = tokens.sparkSession
    if not lengths:
        return spark.createDataFrame([], f"ex_id {dict(tokens.dtypes)['ex_id']}, side string, vocab string, s int, e int, toks array<string>")

    parts = []
    if 1 in counted:
        single = tokens.select("ex_id", "side", F.posexplode("toks").alias("s", "token")).withColumn("share", F.pmod(F.xxhash64("ex_id", "s"), F.lit(SHARES)).cast("int"))
        ones = terms.where("n = 1").select("vocab", F.get("toks", F.lit(0)).alias("token"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        parts.append(single.join(ones, ["token", "share"]).select("ex_id", "side", "vocab", "s", (F.col("s") + 1).alias("e"), F.array("token").alias("toks")))
    if more := [n for n in lengths if n > 1]:
        several = terms.where("n > 1")
        bits = min(SIEVE_BITS, max(1, sum(counted[n] for n in more).bit_length()))
        runs = _sifted(bits, more, spark.sparkContext.broadcast(_sieve(several, bits)))
        near = tokens.select("ex_id", "side", "toks", F.explode(runs(_hashed(F.col("toks")))).alias("w"))
        found = near.select("ex_id", "side", "w.s", F.slice("toks", F.col("w.s") + 1, F.col("w.n")).alias("toks")).join(several, "toks")
        parts.append(found.select("ex_id", "side", "vocab", "s", (F.col("s") + F.col("n")).cast("int").alias("e"), "toks"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def without_duplicates(matches: DataFrame) -> DataFrame:
    return matches.select("ex_id", "side", "vocab", "s", "e").distinct()


def by_example(matches: DataFrame, allow_subset_matches: bool = False) -> DataFrame:
    """(ex_id, spans): the different matches of each example as array<struct<vocab, side, s, e>>, in order, without those
    that lie inside another of their vocabulary and side, unless allowed; partial overlaps stay."""
    spans = F.array_sort(F.collect_set(F.struct("vocab", "side", "s", (-F.col("e")).alias("e"))))
    found = matches.groupBy("ex_id").agg(spans.alias("spans"))
    kept = F.col("spans") if allow_subset_matches else _outermost()(F.col("spans"))
    return found.select("ex_id", F.transform(kept, lambda m: F.struct(m["vocab"].alias("vocab"), m["side"].alias("side"), m["s"].alias("s"), (-m["e"]).alias("e"))).alias("spans"))


def _outermost():
    """Of sorted spans those that end after all that came before them in their vocabulary and side; e is negative."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<struct<vocab:string,side:string,s:int,e:int>>")
    def keep(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if not len(flat):
            return lists
        codes = [flat.field(x).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in ("vocab", "side")]
        run = np.cumsum(np.any([np.diff(x, prepend=-1) != 0 for x in (np.repeat(np.arange(len(sizes)), sizes), *codes)], axis=0)).astype(np.int64)
        # Runs come one after another, so one running maximum serves for all: a later run's ends count for more.
        end = -flat.field("e").to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.maximum.accumulate((run << 32) + end)
        good = np.ones(len(end), bool)
        good[1:] = (run[1:] != run[:-1]) | (end[1:] > before[:-1] - (run[1:] << 32))
        left = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(good)))

    return keep


def as_rows(spans: DataFrame) -> DataFrame:
    """by_example's spans as rows (ex_id, side, vocab, s, e)."""
    return spans.select("ex_id", F.explode("spans").alias("m")).select("ex_id", "m.side", "m.vocab", "m.s", "m.e")


def without_contained(matches: DataFrame) -> DataFrame:
    """Without the spans that lie inside another; partial overlaps stay."""
    return as_rows(by_example(matches))


def only_local(matches: DataFrame, local: DataFrame, strict: bool = False) -> DataFrame:
    """Of examples that have terms of their own in a vocabulary only those matches; of others all, unless `strict`.

    local: (ex_id, vocab, toks).
    """
    own = matches.join(local.select("ex_id", "vocab", "toks").distinct(), ["ex_id", "vocab", "toks"], "left_semi")
    if strict:
        return own
    return own.unionByName(matches.join(local.select("ex_id", "vocab").distinct(), ["ex_id", "vocab"], "left_anti").select(*own.columns))


def not_found(matches: DataFrame, local: DataFrame) -> DataFrame:
    """(ex_id, vocab, term) of the terms that an example names and its reference doesn't hold."""
    ref = matches.where("side = 'ref'").select("ex_id", "vocab", "toks").distinct()
    return local.join(ref, ["ex_id", "vocab", "toks"], "left_anti").select("ex_id", "vocab", "term").distinct()


def matches_by_example(tokens: DataFrame, terms: DataFrame, local: DataFrame | None = None, *, allow_subset_matches: bool = False, only_local_matches: bool = False, strict_local: bool = False) -> DataFrame:
    """The matches that the options ask for, as `by_example`."""
    found = occurrences(tokens, terms)
    if only_local_matches and local is not None:
        found = only_local(found, local, strict_local)
    return by_example(found, allow_subset_matches)


def select_matches(tokens: DataFrame, terms: DataFrame, local: DataFrame | None = None, **options) -> DataFrame:
    """(ex_id, side, vocab, s, e) of the matches that the options ask for."""
    return as_rows(matches_by_example(tokens, terms, local, **options))

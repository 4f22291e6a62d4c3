"""Spelling variants in the sidecar texts: words one edit apart, found by bit-sliced position indexes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.session import pin

LETTERS = "A-Za-zÀ-ÿ"
# Words of one index at most, where a finer cut of the words is possible.
GROUP = 32_768
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = ["m", "low", "high", "head", "tail"]


def word_runs(sidecars: DataFrame, key: str = "key", content: str = "content", least_length: int = 7) -> DataFrame:
    """``key, word``: every maximal run of letters of at least ``least_length`` code points, A-Z lower-cased, one row each
    time it occurs. A null or empty text has none; a repeated row counts again; a null key stays null."""
    runs = F.expr(f"regexp_extract_all(`{content}`, '[{LETTERS}]{{{least_length},}}', 0)")
    rows = sidecars.select(F.col(key).alias("key"), F.explode(runs).alias("word"))
    return rows.withColumn("word", F.when(F.rlike("word", F.lit("[A-Z]")), F.translate("word", _UPPER, _LOWER)).otherwise(F.col("word")))


def vocabulary(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``word, n``: how often each word of at least ``least_length`` code points occurs, from ``least_count`` on."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cut(frame: DataFrame, parts: Column) -> DataFrame:
    """A row per part (``low, high``): what is before it (head), in it (middle) and after it (tail). Places count from the left up to
    ``low`` and from the right from ``high`` on, in words of ``m`` letters; a word of one more has it in its middle."""
    rest = F.col("m") - F.col("high")
    rows = frame.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.low", "p.high").where("low < high")
    return rows.select("n", "m", "low", "high", F.substring("word", F.lit(1), F.col("low")).alias("head"),
                       F.substring("word", F.length("word") - rest + 1, rest).alias("tail"),
                       F.substring("word", F.col("low") + 1, F.length("word") - rest - F.col("low")).alias("middle"))


def _part(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2)
    return F.array(_part(low, middle), _part(middle, high))


def pieces(words: DataFrame, group: int = GROUP) -> DataFrame:
    """The words by what one edit leaves unchanged: ``m, low, high, head, tail, middle, n``.

    Two words one edit apart, the shorter of ``m`` letters, agree before and behind the half in which they first differ. So every
    word is cut in halves twice, as the shorter (m its length) and as the longer one (m one less). Where more than ``group`` words
    share head and tail, their middle is cut in two again, until it is at most two letters long: then no more words can share
    head and tail than the alphabet has runs of three letters. No two words that are near lose each other.
    """
    both = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).where("m > 0")
    least = words.agg(F.min(F.length("word"))).first()[0]
    now = _cut(both.where(F.col("m") >= (least or 0)), _halves(F.lit(0), F.col("m")))
    while True:
        hot = pin(now.where("high - low > 2").groupBy(F.xxhash64(*_PLACE).alias("_hot")).count().where(F.col("count") > group).select("_hot"))
        if hot.isEmpty():
            return now
        marked = now.withColumn("_key", F.xxhash64(*_PLACE)).join(hot, F.col("_key") == F.col("_hot"), "left")
        again = F.col("_hot").isNotNull() & (F.col("high") - F.col("low") > 2)
        finer = marked.where(again).withColumn("word", F.concat("head", "middle", "tail"))
        now = pin(marked.where(~again).select(*now.columns).unionByName(_cut(finer, _halves(F.col("low"), F.col("high")))))


def near_sets(middles: Sequence[str], size: int, last: bool) -> list[int]:
    """For each middle the set, as bits, of those one edit away that first differ from it within the part.

    The index holds a bit set over the words for each (place, letter). A word is read once: ``same`` are the words equal so far;
    those that differ here move to the sets with one error, whose next letters are compared at the same place (replaced), one place
    on (the other is longer) or one back (the other is shorter). Middles have ``size`` letters or one more. Words that differ
    only behind the part, or two of ``size`` + 1 letters, belong to other parts; words that end first do so in the ``last`` one.
    """
    index: list[dict[str, int]] = [{} for _ in range(size + 2)]
    short, longer, bit = 0, 0, 1
    for word in middles:
        if len(word) == size:
            short |= bit
        else:
            longer |= bit
        for at, letter in enumerate(word):
            slot = index[at]
            slot[letter] = slot.get(letter, 0) | bit
        bit <<= 1
    everything, found = bit - 1, []
    for word in middles:
        same, one, other = everything, 0, 0
        if len(word) == size:
            for at, letter in enumerate(word):
                here, ahead = index[at].get(letter, 0), index[at + 1].get(letter, 0)
                equal = same & here
                apart = same ^ equal
                one = one & here | apart & short
                other = (other | apart) & ahead
                same = equal
            found.append(one & short | other & longer | (same & longer if last else 0))
        else:
            for at, letter in enumerate(word):
                here = index[at].get(letter, 0)
                equal = same & here
                one &= index[at - 1].get(letter, 0)  # none have one error before the first letter
                if at < size or last:
                    one |= same ^ equal
                same = equal
            found.append(one & short)
    return found


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, n_near, near, near_n``: of every word that has near ones, their number, the one that occurs most (ties: the
    smallest in code-point order) and how often it does. No pairs are made: a part gives one row per word."""
    groups = pieces(words, group).groupBy(*_PLACE).agg(F.collect_list("middle").alias("middles"), F.collect_list("n").alias("counts")) \
        .where(F.size("middles") > 1)

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = [], [], [], []
            for m, low, high, head, tail, middles, counts in zip(*(c.to_pylist() for c in batch.columns)):
                order = sorted(range(len(middles)), key=lambda i: (-counts[i], middles[i] + tail))
                middles = [middles[i] for i in order]
                for i, near in enumerate(near_sets(middles, high - low, high == m)):
                    if near:
                        best = (near & -near).bit_length() - 1
                        out[0].append(head + middles[i] + tail)
                        out[1].append(near.bit_count())
                        out[2].append(head + middles[best] + tail)
                        out[3].append(counts[order[best]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                ["word", "n_near", "near", "near_n"])

    found = groups.mapInArrow(run, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best) \
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: forms followed to the last, twice as far in each round. A form occurs more
    often than its word, so there are no rings."""
    now = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        now = pin(now.join(on, F.col("root") == F.col("_from"), "left")
                  .select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = 10, group: int = GROUP) -> DataFrame:
    """One row per word of ``words`` (distinct ``word``, ``n``): ``word, form, root, n, n_near, form_n``.

    Near are two words that differ by one inserted, deleted or replaced code point. ``form`` is the near word that occurs most (ties:
    the smallest in code-point order), if at least ``ratio`` times as often, else null; ``root`` is reached by following forms
    to the last, the word itself if it has none.

    Null words have no letters and are left out, as is the empty one; further columns are ignored; no words, no rows.
    """
    words = pin(words.where("length(word) > 0").select("word", F.col("n").cast("bigint").alias("n")))
    near = near_words(words, group)
    takes = F.col("near_n") >= ratio * F.col("n")
    rows = pin(words.join(near, "word", "left").select(
        "word", F.when(takes, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(takes, F.col("near_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

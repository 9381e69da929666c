"""How often every term (n-gram) occurs and in how many records, by sorted suffixes (problem 1).

Each record gives one suffix per position, cut to `longest` terms. Suffixes are routed by their
first term, sorted in reverse lexicographic order, and read once: a stack holds the terms of the
suffix in hand, each with what was counted under it, so all prefixes of all suffixes are counted
in one pass.

Records are counted without carrying their ids. If a suffix repeats an n-gram of the same record,
all of its shorter prefixes are repeated too; so the length `seen` of the longest prefix that the
record showed before says for each prefix whether this is the record's first showing of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term is a longest run of Unicode letters and digits.
TERM = r"[\p{L}\p{Nd}]+"
#: Parts of the suffixes of one first term, by their second term; the parts' counts are added in the end.
SALTS = 16
#: Suffixes gathered in a task's memory before they are handed on.
GATHER = 200_000


def _suffixes(longest: int):
    """Suffixes of each record's terms, equal ones of a task summed; equal records of a batch are cut once."""
    kinds = pa.schema([("field", pa.string()), ("suffix", pa.list_(pa.string())), ("seen", pa.int32()), ("n", pa.int64())])

    def frame(counts: Counter) -> pa.RecordBatch:
        columns = [[k[0] for k in counts], [list(k[1]) for k in counts], [k[2] for k in counts], list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            equal = pa.Table.from_batches([batch]).group_by(["field", "value", "cut"]).aggregate([([], "count_all")]).to_pydict()
            for field, value, cut, n in zip(equal["field"], equal["value"], equal["cut"], equal["count_all"]):
                terms = value.split(" ") if cut else [value]
                shown: set = set()
                for i in range(len(terms)):
                    suffix = tuple(terms[i : i + longest])
                    seen = 0
                    while seen < len(suffix) and suffix[: seen + 1] in shown:
                        seen += 1
                    shown.update(suffix[: k + 1] for k in range(seen, len(suffix)))
                    counts[field, suffix, seen] += n
                if len(counts) > GATHER:
                    yield frame(counts)
                    counts = Counter()
        if counts:
            yield frame(counts)

    return run


def _stacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all prefixes of suffixes that come sorted; the stack outlives the batches."""
    field, stack, out = None, [], []  # stack: [term, occurrences, records]

    def pop(depth: int) -> None:
        while len(stack) > depth:
            out.append((field, " ".join(t for t, _, _ in stack), len(stack), stack[-1][1], stack[-1][2]))
            _, n, records = stack.pop()
            if stack:
                stack[-1][1] += n
                stack[-1][2] += records

    for batch in batches:
        for f, suffix, seen, n in zip(batch["field"], batch["suffix"], batch["seen"], batch["n"]):
            terms = list(suffix)
            shared = 0
            if f == field:
                while shared < min(len(stack), len(terms)) and stack[shared][0] == terms[shared]:
                    shared += 1
            pop(shared)
            field = f
            stack.extend([t, 0, 0] for t in terms[shared:])
            stack[len(terms) - 1][1] += n
            if seen < len(terms):
                stack[len(terms) - 1][2] += n
                if seen:
                    stack[seen - 1][2] -= n
        if out:
            yield pd.DataFrame(out, columns=["field", "term", "length", "occurrences", "records"])
            out.clear()
    pop(0)
    if out:
        yield pd.DataFrame(out, columns=["field", "term", "length", "occurrences", "records"])


def term_frequencies(df: DataFrame, texts: list[str] = (), codes: list[str] = (), longest: int = 3, least_records: int = 5, most_share: float = 0.1) -> DataFrame:
    """field, term, length, occurrences, records, mark for every n-gram of 1..longest terms.

    texts: columns of which the lower-cased text is cut into TERMs. codes: columns of which the
    value itself, as text, is the one term. mark is "rare" for n-grams of fewer than
    least_records records, "common" for those in more than most_share of all rows of df, else
    null. Every row counts as a record, repeated rows as well. Null, empty and term-free texts
    give no term but count as rows; an empty df gives no row.

    Equal records of a batch are cut once, equal suffixes of a task are summed before they are
    shuffled, and the suffixes of one first term go to SALTS places by their second term; so a
    value or term that fills a third of the rows is a few rows per task. No text is shuffled, only its
    suffixes of up to longest terms.
    """
    total = df.count()
    cut = [F.struct(F.lit(c).alias("field"), F.array_join(F.regexp_extract_all(F.lower(F.col(c).cast("string")), F.lit(TERM), F.lit(0)), " ").alias("value"), F.lit(True).alias("cut")) for c in texts]
    whole = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(False).alias("cut")) for c in codes]
    records = df.select(F.explode(F.array(*cut, *whole)).alias("p")).select("p.*").where(F.col("value").isNotNull() & (~F.col("cut") | (F.col("value") != "")))
    suffixes = records.mapInArrow(_suffixes(longest), "field string, suffix array<string>, seen int, n bigint")
    routed = suffixes.repartition("field", F.get("suffix", F.lit(0)), F.pmod(F.hash(F.get("suffix", F.lit(1))), F.lit(SALTS)))
    counted = routed.sortWithinPartitions(F.desc("field"), F.desc("suffix")).mapInPandas(_stacked, "field string, term string, length int, occurrences bigint, records bigint")
    sums = counted.groupBy("field", "term", "length").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < least_records, "rare").when(F.col("records") > most_share * total, "common")
    return sums.withColumn("mark", mark)

"""Fill-in-the-middle transformation (operator 13).

A text is cut into units (lines, by default) at two ranks drawn from a hash of
its key: prefix, middle and suffix. The parts are put in the order that a
model sees, each after its mark: prefix, suffix, middle (``psm``) or suffix,
prefix, middle (``spm``). The code point at which a cut stands comes from an
indexable skip list over the units: every link of every lane carries how many
units and how many code points it passes, so going down from the sparsest lane
and adding up the widths passed ends exactly at the rank.

A text's row is transformed where it stands: nothing is shuffled.

Edge cases: a null text is empty; a text that is empty or holds one of the
marks stays as it is (``plain``), so that an output can be taken apart again;
a null key counts as an empty one; equal rows get equal outputs, rows of equal
keys and different texts equal hashes; a text of one unit has an empty prefix
or suffix, or both; an empty table gives an empty table; other columns,
whatever their names, pass through. A text is a row, which a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import row_of, small_batches, text_of

#: A line with its end.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of texts that are transformed, and of these in the order ``spm``.
RATE, SPM_RATE = 100, 50
#: A unit in 2 ** LANE_BITS of a lane is on the next lane too, on average.
LANE_BITS = 2


class SkipList:
    """An indexable skip list over units of the given widths in code points.

    ``lanes[k]`` has, for each node of lane ``k`` in order, its place in the
    lane below, the units and the code points that its link passes. The head
    is on every lane; the last link of a lane leads to the end. A unit's
    height is drawn from a generator of its own, so a list is the same
    whenever it is built."""

    def __init__(self, widths: list[int], seed: int = SEED, lane_bits: int = LANE_BITS):
        n = len(widths)
        units, points, below = np.ones(n, np.int64), np.array(widths, np.int64), np.arange(n)
        self.lanes = [(below, units, points)]
        # a node's height: how often in a row lane_bits random bits are all zero
        height = np.random.default_rng([seed, n]).geometric(1 - 2.0 ** -lane_bits, n) - 1
        while len(units) > 1:
            on = height >= len(self.lanes)
            on[:1] = True
            starts = np.flatnonzero(on)
            if len(starts) == len(units):
                break
            units, points, height = np.add.reduceat(units, starts), np.add.reduceat(points, starts), height[starts]
            self.lanes.append((starts, units, points))

    def offset(self, rank: int) -> int:
        """The code points before the unit of this rank (all, at the end)."""
        at = passed = offset = 0
        for below, units, points in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, offset, at = passed + int(units[at]), offset + int(points[at]), at + 1
            if passed == rank:
                break
            at = int(below[at])
        return offset


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four numbers below 2 ** 32 from a text's key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(key: object, text: str, pattern: re.Pattern[str], seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    widths = [len(x) for x in pattern.findall(text)]
    n = len(widths)
    if sum(widths) != len(text):
        raise ValueError("the units don't make up the whole text")
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(widths, seed)
    low, high = (units.offset(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_rate:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = LINE, seed: int = SEED,
                rate: int = RATE, spm_rate: int = SPM_RATE, carry: list[str] | None = None) -> DataFrame:
    """``(doc, n, form, prefix_chars, middle_chars, output)`` for every text;
    ``doc`` has all columns of the input, or those of ``carry``."""
    small_batches(docs)
    rows = docs.select(row_of(docs.select(carry) if carry else docs), F.col(key).cast("string").alias("key"), text_of(text).alias("text"))
    pattern = re.compile(unit)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transform(k, t, pattern, seed, rate, spm_rate)
                    for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())]
            columns = list(zip(*made)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, columns, types)], names=["doc", *names])

    added = [T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in zip(names, types)]
    return rows.mapInArrow(cut, T.StructType([rows.schema["doc"], *added]))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text from an output and its form. (The parts hold no mark, so each
    mark stands once.)"""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    last = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(output, MIDDLE, 1)

    def part(mark: str, after: str) -> Column:
        return F.substring_index(F.substring_index(before, mark, -1), after, 1)
    whole = F.concat(part(PREFIX, SUFFIX), last, part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).otherwise(whole)

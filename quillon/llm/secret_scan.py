"""Secret scans with built-in functions only.

Places of a pattern are found without a position function: splitting a text
at the matches and extracting the matches gives alternating pieces, and the
running sum of their lengths gives code point offsets.  Beside the base
patterns, runs of token characters are compared under two character Markov
models, of random strings and of ordinary identifiers; the log-likelihood
ratio is a sum of integers from a table that is trained from the labelled
samples below, so it has no rounding.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As every match is a whole run, a length can stand in these two patterns.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIN_VALUE = 8
#: Runs that the Markov models judge, and the least log-likelihood ratio of a character (in thousandths of a nat).
RUN, LEAST = "[A-Za-z0-9_+/=-]{20,}", 250
KINDS = ("assign", "access", "hex", "random")
#: States of the models: the characters of a run.
STATES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_+/=-"
#: Ordinary identifiers are made of these.  Fixed values.
PARTS = "account address amount async base batch buffer build cache client close code commit config connection context count create customer data date delete description device domain element email error event export field file filter first format from generate get group header height host import index info instance interface internal item key label length level license link list load location lock log manager map message model module name next node number offset option order owner page parameter parse path payment person position post process product profile protocol provider public queue range read reference region register remote remove render request resource response return role route sample schedule schema search section select sequence server service set setting shipping sort source start status step store string structure submit support switch system target task template text thread time token total trace transfer tree trigger update upload user value vector version window with work write zone".split()


def samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones over usual alphabets, 0 for identifiers, words and paths."""
    rng, out = random.Random(seed), []
    alphabets = (STATES[:62], "0123456789abcdef", STATES[:36], STATES[:10] + STATES[36:62], STATES[:62] + "+/", STATES[:62] + "-_")
    for i in range(n):
        alphabet = alphabets[i % len(alphabets)]
        padding = "=" * rng.randrange(3) if "+" in alphabet else ""
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44))) + padding, 1))
        parts = [rng.choice(PARTS) for _ in range(rng.randint(3, 6))]
        number = str(rng.choice((1, 2, 3, 10, 16, 64, 100, 2024, 2025))) if rng.random() < 0.2 else ""
        rule = "-" * 20 if i % 50 == 0 else "=" * 20 if i % 50 == 1 else ""
        forms = ("_".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "".join(p.title() for p in parts), "".join(parts), "_".join(parts).upper(), "-".join(parts), "/" + "/".join(parts), "=".join(parts[:2]) + "/" + "-".join(parts[2:]))
        out.append((rule or forms[i % len(forms)] + number, 0))
    return out


def train(labelled: list[tuple[str, int]] | None = None) -> list[int]:
    """log P(next | state, random) - log P(next | state, ordinary) in thousandths, by state and next character.

    Transitions are mixed with the frequencies of single characters, so that
    none is impossible and words of other languages, with transitions that
    the sample lacks, stay ordinary.
    """
    labelled = samples() if labelled is None else labelled
    k, at = len(STATES), {c: i for i, c in enumerate(STATES)}
    pair = [[[0.0] * k for _ in range(k)] for _ in range(2)]
    one = [[1.0] * k for _ in range(2)]
    for s, y in labelled:
        codes = [at[c] for c in s if c in at]
        for a, b in zip(codes, codes[1:]):
            pair[y][a][b] += 1
            one[y][b] += 1
    prob = [[[0.0] * k for _ in range(k)] for _ in range(2)]
    for y in range(2):
        total = sum(one[y])
        for a in range(k):
            seen = sum(pair[y][a])
            for b in range(k):
                back = one[y][b] / total
                prob[y][a][b] = (pair[y][a][b] + 20 * back) / (seen + 20)
    return [round(1000 * math.log(prob[1][a][b] / prob[0][a][b])) for a in range(k) for b in range(k)]


def _places(text: Column, pattern: str, kind: str, value: bool = False) -> Column:
    """Array of (start, kind number, kind, end, match) of leftmost non-overlapping matches."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if value else got
    size = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))
    # a match ends after all gaps and matches up to it
    sizes, gaps = size(got), F.slice(size(F.split(text, pattern, -1)), F.lit(1), F.greatest(F.lit(0), F.size(got)))
    rows = F.arrays_zip(running_sums(F.zip_with(gaps, sizes, lambda a, b: a + b)).alias("end"), sizes.alias("size"), got.alias("match"), kept.alias("value"))

    def place(r: Column) -> Column:
        return F.struct((r["end"] - r["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("number"), F.lit(kind).alias("kind"), r["end"].alias("end"), r["match"].alias("match"), r["value"].alias("value"))

    return F.when(text.rlike(pattern), F.transform(rows, place)).otherwise(F.lit([]).cast(_PLACE))


def running_sums(xs: Column) -> Column:
    """Sums of an array of bigints up to each element.

    The array is added to itself, moved by 1, 2, 4, ... places: n elements
    take log2(n) passes, and no array grows element by element.
    """
    def double(acc: Column, by: Column) -> Column:
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0).cast("long"), by), F.slice(acc, F.lit(1), F.size(acc) - by)), lambda a, b: a + b)

    one = F.transform(F.array(xs), lambda x: F.aggregate(F.filter(F.lit([1 << k for k in range(31)]), lambda by: by < F.size(x)), x, double))
    return F.get(one, F.lit(0))


_PLACE = "array<struct<start:bigint,number:int,kind:string,end:bigint,match:string,value:string>>"


def ratio(run: Column, table: list[int]) -> Column:
    """Sum over a run's characters of the trained log-likelihood ratios, in thousandths."""
    k, values = len(STATES), F.lit(table)
    number = F.lit([max(0, STATES.find(chr(i))) for i in range(128)])

    def total(codes: Column) -> Column:
        n = F.size(codes) - 1
        steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(values, a * k + b))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    codes = F.transform(F.split(run, ""), lambda c: F.get(number, F.ascii(c)))
    return F.get(F.transform(F.array(codes), total), F.lit(0))


def scan(docs: DataFrame, text: str = "text", table: list[int] | None = None, least: int = LEAST) -> DataFrame:
    """Columns of ``docs`` with base and spans: arrays of (start, number, kind, end, match, value).

    base has the places of the three patterns, spans also the runs that the
    Markov models call random; both in the order of start, then kind.  start
    and end count code points, end exclusive.  A null text is an empty one
    and has none.  Rows stay as they are; columns with the names of results
    are replaced.
    """
    table = train() if table is None else table
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_places(body, ASSIGN, "assign", True), lambda p: F.char_length(p["value"]) >= MIN_VALUE)
    # every access key of 16 characters or more and every hex run is told apart by its own pattern
    access = F.when(body.contains("AKIA"), _places(body, ACCESS, "access")).otherwise(F.lit([]).cast(_PLACE))
    out = docs.drop("base", "spans", "__runs").withColumn("__a", assign).withColumn("__k", access).withColumn("__h", _places(body, HEX, "hex"))
    judged = F.filter(_places(body, RUN, "random"), lambda p: ratio(p["match"], table) >= least * (F.char_length(p["match"]) - 1))
    return out.withColumn("__r", judged).withColumn("base", F.array_sort(F.concat("__a", "__k", "__h"))).withColumn("spans", F.array_sort(F.concat("base", "__r"))).drop("__a", "__k", "__h", "__r")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")

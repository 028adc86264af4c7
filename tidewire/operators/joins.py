"""Join shapes the engine needs beyond plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T


def window_pairs(rows: DataFrame, ts: str, key: str, hours: int, carry: tuple[str, ...] = (), salts: int = 1, on: Column | None = None, by: str | None = None) -> DataFrame:
    """Pairs (earlier, later) at most ``hours`` apart, ordered by (ts, key), with ``by`` only inside its groups; rows without a time pair with nothing.

    A range condition alone would plan as a nested loop. Here each row lies in one bucket of ``hours``; as the earlier of a pair it is also offered to
    the next bucket, so equality on buckets finds each pair once. ``salts`` deals the later side of a crowded bucket over several tasks.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    span = hours * 3_600_000_000
    group = {"__g": F.col(by)} if by else {}
    timed = rows.filter(F.col(ts).isNotNull()).select(F.col(key), seconds.alias("__t"), *carry, *(c.alias(k) for k, c in group.items())).withColumn("__b", F.floor(F.col("__t") / span).cast("long"))
    early = timed.select(*(F.col(c).alias(f"e_{c}") for c in (key, *carry)), F.col("__t").alias("e_t"), *group, F.explode(F.array("__b", F.col("__b") + 1)).alias("__b"))
    late = timed.select(*(F.col(c).alias(f"l_{c}") for c in (key, *carry)), F.col("__t").alias("l_t"), *group, "__b")
    keys = ["__b", *group]
    if salts > 1:
        late = late.withColumn("__s", F.pmod(F.xxhash64(f"l_{key}"), F.lit(salts)).cast("int"))
        early = early.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("__s")
    pairs = early.join(late, keys).filter((F.col("l_t") - F.col("e_t") <= span) & (F.struct("e_t", f"e_{key}") < F.struct("l_t", f"l_{key}")))
    if on is not None:
        pairs = pairs.filter(on)
    return pairs.withColumn("hours", (F.col("l_t") - F.col("e_t")) / 3.6e9).drop(*keys, "e_t", "l_t")


HOUR, SECOND = 3_600_000_000, 1_000_000


def window_totals(rows: DataFrame, ts: str, key: str, hours: int) -> DataFrame:
    """One row (pairs, micros): how many pairs ``window_pairs`` makes, and the sum of the microseconds between their times (null where there are none), without making them.

    Rows count by their time first. A pair then lies in one second, in one hour, in two hours less than ``hours`` apart, or in hours just so far apart, where the earlier offset must
    not be the smaller one. Each case is a sum over cells: running sums inside a second or an hour, whole hours against the ones before. So the work follows the rows, and a window
    holds at most a second's microseconds or an hour's seconds, however crowded a time is.
    """
    whole, span = "decimal(38,0)", hours * HOUR
    timed = rows.filter(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(key).alias("k"))
    at = timed.groupBy("t", "k").agg(F.count("*").cast(whole).alias("m")).groupBy("t").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"))
    start = lambda c, unit: F.col(c) - F.pmod(F.col(c), F.lit(unit))
    none = F.lit(0).cast(whole)

    def cells(unit: int, within: int) -> DataFrame:
        """(u, n, q): of each cell of ``unit`` its start, rows, and the sum of their offsets in the cell of ``within`` round it."""
        return at.groupBy(start("t", unit).alias("u")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pmod("t", F.lit(within)).cast(whole)).alias("q"))

    def met(each: DataFrame, old: DataFrame) -> DataFrame:
        """Cells beside what lies so many hours before them: (u, n, q, c, p, away), the latter rows, offsets, and rows times the microseconds between the cells."""
        both = each.select("u", "n", "q", none.alias("c"), none.alias("p"), none.alias("away")).unionAll(old)
        return both.groupBy("u").agg(*(F.sum(x).alias(x) for x in ("n", "q", "c", "p", "away")))

    def inside(unit: int, within: int, equal: int) -> DataFrame:
        """Of each cell: earlier ones in its ``within``, and in the one ``hours`` before those at a later offset, or as late with ``equal``."""
        each = cells(unit, within)
        both = met(each, each.select(F.col("u") + F.lit(span), none, none, "n", "q", F.col("n") * F.lit(span).cast(whole)))
        w = Window.partitionBy(start("u", within)).orderBy("u")
        until = lambda c, last: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, last)), none)
        after = lambda c: F.sum(c).over(Window.partitionBy(start("u", within))) - until(c, -equal)  # a frame up to the end is summed anew for each row
        return both.select("n", "q", (until("n", -1) + after("c")).alias("c"), (until("q", -1) + after("p")).alias("p"), after("away").alias("away"))

    each = cells(HOUR, HOUR)
    past = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("j")).filter("j > 0").withColumn("far", F.col("j").cast("long") * F.lit(HOUR))
    apart = met(each, past.select(F.col("u") + F.col("far"), none, none, "n", "q", F.col("n") * F.col("far").cast(whole))).drop("u")
    levels = inside(1, SECOND, 1).unionByName(inside(SECOND, HOUR, 0)).unionByName(apart)
    n, q, c = F.col("n"), F.col("q"), F.col("c")
    found = levels.select((n * c).alias("pairs"), (q * c - n * F.col("p") + n * F.col("away")).alias("micros"))
    tied = at.select((F.col("n") * F.col("n") - F.col("own")).alias("pairs"), none.alias("micros"))  # each pair of one time twice
    sums = found.select((F.col("pairs") * 2).cast(whole).alias("pairs"), "micros").unionByName(tied.select(F.col("pairs").cast(whole), "micros")).agg(F.coalesce(F.sum("pairs"), none).alias("p"), F.sum("micros").alias("micros"))
    return sums.select(F.expr("p div 2").alias("pairs"), F.when(F.col("p") > 0, F.col("micros")).alias("micros"))


def tokens_in_common(rows: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a, b) with a < b whose token sets overlap by a Jaccard similarity of ``least`` or more, and the similarity.

    Prefix filter: such sets share one of their rarest tokens, so rows meet by those few only, never by a word that most rows hold.
    """
    sets = rows.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("t")).filter(F.size("t") > 0)
    each = sets.select("id", F.size("t").alias("n"), F.explode("t").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = each.join(often, "token").withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(least * F.col("n")) + 1).select("id", "n", "token")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "token"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "token")
    near = a.join(b, "token").filter((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("a", "b").distinct()
    full = near.join(sets.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    sim = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return full.select("a", "b", sim.alias("jaccard")).filter(F.col("jaccard") >= least)


def overlaps(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap, coverage) of rows (id, t) of two tables whose token sets overlap by ``least`` or more of the smaller.

    The smaller set of such a pair has one of its rarest tokens in common with the other, so pairs meet by those of one side only, never by a word that most rows hold.
    """
    sides = [d.filter(F.size("t") > 0).select("id", F.size("t").alias("n"), "t") for d in (left, right)]
    each = [d.select("id", "n", F.explode("t").alias("token")) for d in sides]
    often = each[0].select("token").unionAll(each[1].select("token")).groupBy("token").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    rare = [d.join(often, "token").withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("id", "n", "token") for d in each]
    a, b = (lambda d: d.select(F.col("id").alias("a"), F.col("n").alias("na"), "token")), (lambda d: d.select(F.col("id").alias("b"), F.col("n").alias("nb"), "token"))
    met = a(rare[0]).join(b(each[1]), "token").filter("na <= nb").select("a", "b").unionAll(a(each[0]).join(b(rare[1]), "token").filter("nb <= na").select("a", "b")).distinct()
    full = met.join(sides[0].select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(sides[1].select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    return full.select("a", "b", F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("overlap"), F.round(T.coverage(F.col("x"), F.col("y")), 6).alias("coverage")).filter(F.col("overlap") >= least)


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], touch: dict[str, Column]) -> DataFrame:
    """The table after an upsert: rows known by ``keys`` only get the columns of ``touch`` (over c and i), others are added. Of rows that arrive twice, the last by all columns counts."""
    latest = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in incoming.columns if c not in keys)))).filter("__r = 1").drop("__r")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    marked = latest.withColumn("__new", F.lit(True))
    joined = current.alias("c").join(marked.alias("i"), same, "left")
    kept = joined.select(*((F.when(F.col("i.__new"), touch[c]).otherwise(F.col(f"c.{c}")) if c in touch else F.col(f"c.{c}")).alias(c) for c in current.columns))
    added = latest.alias("i").join(current.alias("c"), same, "left_anti").select(*current.columns)
    return kept.unionByName(added)


def append_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert only: what the table has stays as it is."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))

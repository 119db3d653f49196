"""Which carts get the stock that many ask for: an ordered fold over all checkouts, taken apart until it runs in parallel.

Two things settle carts. Bounds: running sums by variant tell what earlier carts take at least and at most, and a cart that
both bounds judge alike is settled, everywhere at once. Folds: open carts that share a contested variant form components,
which don't touch each other, so each is folded in order in one task. A long chain of carts is one component and takes one
fold, however long; of a component over ``fold_lines`` lines the earliest ones are folded first, as they depend on none of
the later, and the rest goes on with what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.ranking import components, running_sums, union_all, with_serials
from quoin.sources.stored import store

ORDER = ["placed_at", "checkout_id"]
OPEN = ["checkout_id", "variant_id", "placed_at", "need", "free"]


def by_cart(lines: DataFrame, carts: DataFrame, how: str = "inner") -> DataFrame:
    """lines joined with carts (cart, ...), null ids included; one cart's lines may meet in several tasks."""
    return lines.join(carts, F.col("checkout_id").eqNullSafe(F.col("cart")), how).drop("cart")


def open_lines(rows: DataFrame, hot_rows: int) -> DataFrame:
    """The open lines of rows (OPEN, state), less what carts admitted since have taken before them, with ``may``: what open carts
    before them ask for."""
    sums = running_sums(rows, "variant_id", ORDER, {"took": F.when(F.col("state"), F.col("need")), "may": F.when(F.col("state").isNull(), F.col("need"))}, hot_rows)
    return sums.filter("state is null").withColumns({"free": F.col("free") - F.col("took"), "may": F.col("may") - F.col("need")}).select(*OPEN, "may")


def by_bounds(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Open lines with a state for each cart that the bounds settle."""
    line = F.when(F.col("free") < F.col("need"), False).when(F.col("free") - F.col("may") >= F.col("need"), True)
    judged = open_lines(rows, hot_rows).withColumn("line", line)
    cart = Window.partitionBy("checkout_id")
    possible, sure = (F.bool_and(F.coalesce("line", F.lit(unknown))).over(cart) for unknown in (True, False))
    return store(judged.select(*OPEN, F.when(~possible, False).when(sure, True).alias("state")), "admission")


def fold(lines: DataFrame) -> DataFrame:
    """(cart, state) of lines (OPEN, component): each component's carts in order, as one call after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        cart: list[tuple[int, int, int]] = []
        now: tuple | None = None
        ids, states = [], []

        def close() -> None:
            ok = all(free - used.get(variant, 0) >= need for variant, need, free in cart)
            if ok:
                for variant, need, _ in cart:
                    used[variant] = used.get(variant, 0) + need
            ids.append(now[1])
            states.append(ok)
            cart.clear()

        for batch in batches:
            for component, checkout, variant, need, free in zip(*(batch.column(c).to_pylist() for c in ("component", "checkout_id", "variant_id", "need", "free")), strict=True):
                if now != (component, checkout):
                    if now is not None:
                        close()
                        if now[0] != component:
                            used.clear()
                    now = (component, checkout)
                cart.append((variant, need, free))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(states, pa.bool_())], names=["cart", "state"])
            ids, states = [], []
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(states, pa.bool_())], names=["cart", "state"])

    dealt = lines.select("component", "checkout_id", "variant_id", "placed_at", "need", "free").repartition("component").sortWithinPartitions("component", *ORDER)
    return dealt.mapInArrow(run, "cart long, state boolean")


def earliest(lines: DataFrame, most: int) -> DataFrame:
    """Of each component the carts that begin within its first ``most`` lines."""
    numbered = with_serials(lines, ["component", *ORDER])
    starts = numbered.groupBy(F.col("component").alias("of")).agg(F.min("serial").alias("start"))
    places = numbered.join(starts, F.col("component") == F.col("of")).withColumn("place", F.col("serial") - F.col("start"))
    first = places.groupBy(F.col("checkout_id").alias("cart")).agg(F.min("place").alias("first")).filter(F.col("first") < most).select("cart")
    return lines.join(first, F.col("checkout_id").eqNullSafe(F.col("cart")), "left_semi")


def in_components(lines: DataFrame, fold_lines: int) -> DataFrame:
    """Open lines on contested variants that can be folded now, with their components."""
    hard = F.bool_or(F.col("free") - F.col("may") < F.col("need"))
    contested = lines.groupBy(F.col("variant_id").alias("v")).agg(hard.alias("hard")).filter("hard").select("v")
    held = store(lines.join(contested, F.col("variant_id") == F.col("v"), "left_semi"), "contested")
    node = F.coalesce("checkout_id", F.lit(-(1 << 63)))  # a cart without an id is one, too
    labelled = store(held.withColumn("node", node).join(components(held.withColumn("node", node), "node", "variant_id"), "node").drop("node"), "components")
    sizes = labelled.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("n"))
    if sizes.filter(F.col("n") > fold_lines).isEmpty():
        return labelled
    small = labelled.join(sizes.filter(F.col("n") <= fold_lines), F.col("component") == F.col("c"), "left_semi")
    large = labelled.join(sizes.filter(F.col("n") > fold_lines), F.col("component") == F.col("c"), "left_semi")
    return small.unionByName(earliest(large, fold_lines))


def admission(requests: DataFrame, stock: DataFrame, rounds: int = 2, fold_lines: int = 500_000, hot_rows: int = 1_000_000) -> DataFrame:
    """Requests (checkout_id, variant_id, placed_at, quantity) by checkouts in order of time, then id: a checkout is admitted if
    what is left of each of its variants' available stock (variant_id, available) holds all that it asks for; one line that
    is not held refuses the whole cart, which then takes nothing. Returns checkout_id, variant_id, quantity, admitted, left.

    Up to fold_lines open lines are folded by one task, which holds so many. Beyond it ``rounds`` rounds of bounds come first, then
    components are folded, over again while carts are open; all ways give the same rows. Variants with over hot_rows lines are summed in range partitions.
    Unknown variants have nothing available; quantities below one or null are refused. Rows that repeat add up.
    """
    asked = store(requests.select("checkout_id", "variant_id", "placed_at", F.col("quantity").cast("int").alias("quantity")), "requests")
    there = stock.select(F.col("variant_id").alias("of"), F.col("available").cast("long").alias("available"))
    needs = asked.groupBy("checkout_id", "variant_id").agg(F.min("placed_at").alias("at"), F.sum("quantity").cast("long").alias("need"), F.bool_and(F.coalesce("quantity", F.lit(0)) >= 1).alias("sound"))
    free = F.when(F.col("sound"), F.coalesce("available", F.lit(0))).otherwise(-1).alias("free")
    lines = needs.join(there, F.col("variant_id") == F.col("of"), "left").select("checkout_id", "variant_id", "at", F.when(F.col("sound"), F.col("need")).otherwise(0).alias("need"), free)
    # What full stock can't hold is refused before anything is counted, and takes nothing.
    cart = Window.partitionBy("checkout_id")
    judged = lines.withColumns({"placed_at": F.min("at").over(cart), "possible": F.bool_and(F.col("free") >= F.col("need")).over(cart)})
    rows = store(judged.select(*OPEN, F.when(~F.col("possible"), False).alias("state")), "admission")
    settled = [rows]
    while True:
        n = rows.filter("state is null").count()
        for _ in range(rounds if n > fold_lines else 0):
            rows = by_bounds(rows, hot_rows)
            settled.append(rows)
        untouched = rows is settled[0]  # nothing is admitted yet
        left = rows.filter("state is null").select(*OPEN) if untouched and n <= fold_lines else store(open_lines(rows, hot_rows), "open")
        n = left.count()
        if not n:
            break
        every = n <= fold_lines
        ready = left.withColumn("component", F.lit(0).cast("long")) if every else in_components(left, fold_lines)
        rows = store(by_cart(left, store(fold(ready), "folded"), "left").select(*OPEN, "state"), "admission")
        settled.append(rows)
        if every:
            break
    known = union_all([r.filter("state is not null").select(F.col("checkout_id").alias("cart"), "placed_at", F.col("state").alias("admitted")) for r in settled]).distinct()
    judged = by_cart(asked.drop("placed_at"), known).join(there, F.col("variant_id") == F.col("of"), "left").drop("of").withColumn("nth", F.monotonically_increasing_id())
    lines = asked.count()
    judged = store(judged, "judged") if lines > hot_rows else judged
    sums = running_sums(judged, "variant_id", [*ORDER, "quantity", "nth"], {"gone": F.when(F.col("admitted"), F.col("quantity").cast("long"))}, hot_rows, lines)
    return sums.select("checkout_id", "variant_id", "quantity", "admitted", (F.coalesce("available", F.lit(0)) - F.col("gone")).cast("int").alias("left"))

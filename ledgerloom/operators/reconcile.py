"""Ledger worksheet against payment records, for every company and period at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_number, safe_date
from ledgerloom.functions.money import MONEY, money_parse
from ledgerloom.plans.ordered import CHUNK_ROWS, Scan, block_of, number_rows, scan, spread_of
from ledgerloom.plans.session import cut_lineage

KEYS = ("company_id", "period")
SUCCESS = ("Settled", "Scheduled")


def filter_payment_period(
    payments: DataFrame, period_text: str | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Federal rows of one period text, or state rows paid inside [start, end]; applied amount first."""
    if period_text is not None:
        status = F.when(F.col("status") == "Return", "Returned").otherwise(F.col("status"))
        kept = payments.withColumn("status", status)
        return kept.filter((F.col("tax_period") == period_text) & F.col("status").isin(*SUCCESS, "Returned"))
    amount = F.coalesce("applied", "orig").cast(MONEY)
    return payments.filter(F.col("pay_date").between(start, end)).withColumn("amount", amount)


def parse_federal_payments(lines: DataFrame) -> DataFrame:
    """Six-line records: settlement, initiation, form, period, amount, status.

    A window over the lines of a document looks five positions ahead.  Long documents are cut into
    chunks of positions, and only the first five lines of a chunk are repeated for the one above.
    """
    chunk = F.floor(F.col("pos") / CHUNK_ROWS)
    into = F.when(F.pmod("pos", F.lit(CHUNK_ROWS)) < 5, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = lines.select("doc_id", "pos", "text", F.explode(into).alias("chunk"))
    ordered = Window.partitionBy("doc_id", "chunk").orderBy("pos")
    part = lambda i, v: F.max(v).over(ordered.rangeBetween(i, i)).alias(f"f{i}")
    dated = F.when(F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("text"))
    # of lines that share a position the first stands for all
    single = F.rank().over(ordered) == F.row_number().over(ordered)
    rows = spread.select("doc_id", F.col("pos").alias("start"), "chunk", part(0, dated), *[part(i, F.col("text")) for i in range(1, 6)], single.alias("single"))
    rows = rows.filter(F.col("single") & (F.col("chunk") == F.floor(F.col("start") / CHUNK_ROWS)))
    status = F.when(F.trim("f5") == "Return", "Returned").otherwise(F.trim("f5"))
    out = rows.filter(F.col("f0").isNotNull() & status.isin(*SUCCESS, "Returned")).select(
        "doc_id", F.col("start").alias("row_no"),
        F.substring("f0", 1, 10).try_cast("date").alias("settlement_date"),
        F.substring("f1", 1, 10).try_cast("date").alias("initiation_date"),
        F.col("f3").alias("tax_period"), money_parse("f4").alias("amount"), status.alias("status"),
    )
    return out.filter(F.col("settlement_date").isNotNull() & F.col("amount").isNotNull())


def parse_state_payments(docs: DataFrame) -> DataFrame:
    """Deposit rows `dd-Mon-yyyy DE88 Payment dd-Mon-yyyy $orig [$applied]` anywhere in the text."""
    pattern = (
        r"(\d{2}-[A-Za-z]{3}-\d{4}\s+DE88\s+Payment\s+\d{2}-[A-Za-z]{3}-\d{4}\s+\$[\d,]+\.\d{2}(?:\s+\$[\d,]+\.\d{2})?)"
    )
    hits = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("row_no", "hit"))
    pay = r"Payment\s+(\d{2})-([A-Za-z]{3})-(\d{4})"
    num = lambda i: F.regexp_extract("hit", pay, i).try_cast("int")
    money = F.regexp_extract_all("hit", F.lit(r"\$([\d,]+\.\d{2})"), 1)
    return hits.select(
        "doc_id", "row_no",
        safe_date(num(3), month_number(F.regexp_extract("hit", pay, 2)), num(1)).alias("pay_date"),
        money_parse(F.try_element_at(money, F.lit(1))).alias("orig"),
        money_parse(F.try_element_at(money, F.lit(2))).alias("applied"),
    ).filter(F.col("pay_date").isNotNull())


def stack_match(events: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Sequence[Column]) -> DataFrame:
    """Bracket matching: every closer pairs with the latest unused opener before it.

    Needs boolean `opens`.  Adds `level` and `matched`; a pair shares its level, with nothing
    of that level between the two.  Depth is a running sum clamped at zero.
    """
    step = F.when(F.col("opens"), 1).otherwise(-1)
    run = scan(events, keys, order, chunk, {"__cum": Scan("sum", step)})
    run = scan(run, keys, order, chunk, {"__low": Scan("min", F.col("__cum")), "__was": Scan("prev_min", F.col("__cum"))})
    floor = F.least(F.lit(0), F.col("__low"))
    # A closer is unmatched exactly when it makes a new minimum below zero.
    lonely = ~F.col("opens") & (F.col("__cum") < F.least(F.lit(0), F.coalesce("__was", F.lit(0))))
    depth = F.col("__cum") - floor
    out = run.withColumn("matched_close", ~F.col("opens") & ~lonely).withColumn(
        "level", F.when(F.col("opens"), depth).when(~lonely, depth + 1)
    )
    return out.drop("__cum", "__low", "__was")


def cancel_returned_payments(payments: DataFrame, keys: Sequence[str] = KEYS, date_chunk: bool = True) -> tuple[DataFrame, DataFrame]:
    """(effective payments, returns with the payment each one cancels or NOT_FOUND).

    Input: keys, row_no, settlement_date, initiation_date, amount, status.
    """
    opens = F.col("status").isin(*SUCCESS)
    far_past, far_future = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    events = payments.filter(opens | (F.col("status") == "Returned")).select(
        *keys, "amount", "settlement_date", "initiation_date", "status", "row_no",
        opens.alias("opens"), F.when(opens, 0).otherwise(1).alias("__phase"),
        F.coalesce("initiation_date", F.when(opens, far_past).otherwise(far_future)).alias("__start"),
    )
    group = [*keys, "amount"]
    order = ["settlement_date", "__phase", "__start", "row_no"]
    # Only a group that is longer than a chunk is cut by date. Groups with a null in their key match
    # nothing across dates, so they are one group a date either way.
    lone = F.when(reduce(or_, [F.col(c).isNull() for c in group]), F.col("settlement_date"))
    long = date_chunk and not events.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > CHUNK_ROWS).isEmpty()
    chunk = [F.col("settlement_date")] if long else None
    whole = group if long or not date_chunk else [*group, "__lone"]
    leveled = stack_match(events.withColumn("__lone", lone), whole, order, chunk)
    paired = scan(
        leveled.filter(F.col("level").isNotNull()),
        [*whole, "level"],
        order,
        chunk,
        {"__mate": Scan("prev_last", F.struct("row_no", "opens", "settlement_date"))},
    )
    hits = paired.filter(F.col("matched_close")).select(
        *group, "row_no", F.col("__mate.row_no").alias("cancelled_row"), F.col("__mate.settlement_date").alias("cancelled_date")
    )
    # Both results and what follows them name the hits, so they are written once.
    hits = cut_lineage(hits)
    returns = (
        events.filter(~F.col("opens"))
        .select(*group, F.col("settlement_date").alias("returned_date"), "row_no")
        .join(hits, [*group, "row_no"], "left")
        .withColumn("cancelled_status", F.when(F.col("cancelled_row").isNull(), "NOT_FOUND").otherwise("Returned"))
    )
    gone = hits.select(*keys, F.col("cancelled_row").alias("row_no"))
    effective = payments.filter(opens).join(gone, [*keys, "row_no"], "left_anti")
    return effective, returns


def returns_repaid(returns: DataFrame, effective: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `repaid`: some effective payment of the same amount settles strictly later."""
    last = effective.groupBy(*keys, "amount").agg(F.max("settlement_date").alias("__last"))
    out = returns.join(last, [*keys, "amount"], "left")
    return out.withColumn("repaid", F.coalesce(F.col("__last") > F.col("returned_date"), F.lit(False))).drop("__last")


def flag_returned_worksheet_rows(ws: DataFrame, returns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `is_returned`: the row's date and total equal a cancelled payment's."""
    hit = (
        returns.filter(F.col("cancelled_date").isNotNull())
        .select(*keys, F.col("cancelled_date").alias("date"), F.col("amount").alias("total"))
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    out = ws.join(hit, [*keys, "date", "total"], "left")
    return out.withColumn("is_returned", F.coalesce("__hit", F.lit(False))).drop("__hit")


def multiset_counts(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per value: n_left, n_right, missing (left surplus) and extra (right surplus)."""
    side = lambda df, a, b: df.select(*cols, F.lit(a).alias("__a"), F.lit(b).alias("__b"))
    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    n = both.groupBy(*cols).agg(F.sum("__a").alias("n_left"), F.sum("__b").alias("n_right"))
    surplus = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return n.withColumn("missing", surplus("n_left", "n_right")).withColumn("extra", surplus("n_right", "n_left"))


def multiset_except(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of left beyond those in right, counting duplicates."""
    return left.select(*cols).exceptAll(right.select(*cols))


def multiset_diff(ws: DataFrame, payments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dates whose amounts differ, with the missing, extra and full lists as text.

    Lists hold distinct amounts with counts, so their size follows distinct values, not rows.
    """
    left = ws.filter(~F.col("is_returned") & (F.col("total") != 0)).select(*keys, "date", F.col("total").alias("amount"))
    right = payments.select(*keys, F.col("settlement_date").alias("date"), "amount")
    counts = multiset_counts(left, right, [*keys, "date", "amount"])
    shown = lambda n: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col(n) > 0, F.struct(F.col("amount").alias("a"), F.col(n).alias("n"))))),
            lambda s: F.concat(s["a"].cast("string"), F.lit("x"), s["n"].cast("string")),
        ),
        ", ",
    )
    out = counts.groupBy(*keys, "date").agg(
        F.sum("missing").alias("n_missing"), F.sum("extra").alias("n_extra"),
        shown("missing").alias("missing"), shown("extra").alias("extra"),
        shown("n_left").alias("worksheet_paid"), shown("n_right").alias("payments_paid"),
    )
    return out.filter((F.col("n_missing") > 0) | (F.col("n_extra") > 0))


def sum_checks(ws: DataFrame, payments: DataFrame, returns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Paid and returned totals of both sides and whether they agree."""
    zero = F.lit(0).cast(MONEY)
    total = lambda c: F.sum(c).cast(MONEY)
    a = ws.groupBy(*keys).agg(
        total(F.when(~F.col("is_returned"), F.col("total"))).alias("ws_paid"),
        total(F.when(F.col("is_returned"), F.col("total"))).alias("ws_returned"),
    )
    b = payments.groupBy(*keys).agg(total(F.col("amount")).alias("pay_paid"))
    c = returns.groupBy(*keys).agg(total(F.col("amount")).alias("pay_returned"))
    out = a.join(b, list(keys), "full_outer").join(c, list(keys), "full_outer")
    cols = ("ws_paid", "pay_paid", "ws_returned", "pay_returned")
    out = out.select(*keys, *[F.coalesce(F.col(x), zero).cast(MONEY).alias(x) for x in cols])
    return out.withColumn("paid_ok", F.col("ws_paid") == F.col("pay_paid")).withColumn(
        "returned_ok", F.col("ws_returned") == F.col("pay_returned")
    )


def match_direct(
    ws: DataFrame, payments: DataFrame, keys: Sequence[str] = KEYS, amount: str = "edd_total", row: str = "row_no"
) -> DataFrame:
    """Worksheet rows with `direct`: the first n rows of an amount match its n payments."""
    have = payments.groupBy(*keys, F.col("amount").alias(amount)).agg(F.count("*").alias("__have"))
    ranked = number_rows(ws, [*keys, amount], [row], [spread_of(row)], "__rn")
    out = ranked.join(have, [*keys, amount], "left")
    return out.withColumn("direct", F.coalesce(F.col("__rn") <= F.col("__have"), F.lit(False))).drop("__rn", "__have")


def match_split_pairs(
    ws: DataFrame,
    payments: DataFrame,
    keys: Sequence[str] = KEYS,
    local_rows: int = 50_000,
) -> DataFrame:
    """Leftover rows (direct = false) whose two parts both remain unpaid take them, in row order.

    Rounds settle every row whose outcome no longer depends on undecided earlier rows:
    demand up to and including it fits the supply (taken), or the supply is already gone
    (refused).  The first undecided row of a group is always settled, so each round makes
    progress; once every open group is small, one Arrow group each finishes in order.
    """
    key_list = list(keys)
    used = ws.filter("direct").groupBy(*keys, F.col("edd_total").alias("amount")).agg(F.count("*").alias("__used"))
    pool = payments.groupBy(*keys, "amount").agg(F.count("*").alias("have")).join(used, [*keys, "amount"], "left")
    pool = pool.select(*keys, "amount", (F.col("have") - F.coalesce("__used", F.lit(0))).alias("have"))
    exact = F.col("ui_ett") + F.col("p_i") == F.col("edd_total")
    open_rows = ws.filter(~F.col("direct") & exact).select(
        *keys, "row_no", F.col("ui_ett").alias("part_a"), F.col("p_i").alias("part_b")
    )
    state = cut_lineage(open_rows.withColumn("split", F.lit(None).cast("boolean")))
    pool = cut_lineage(pool)

    while True:
        undecided = state.filter(F.col("split").isNull())
        sizes = undecided.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"]
        if not sizes:
            break
        taken = state.filter("split")
        spent = _demand(taken, keys).groupBy(*keys, "amount").agg(F.sum("need").alias("spent"))
        left = pool.join(spent, [*keys, "amount"], "left").select(
            *keys, "amount", (F.col("have") - F.coalesce("spent", F.lit(0))).alias("left")
        )
        if sizes <= local_rows:
            rest = _finish_groups(undecided, left, key_list)
            state = cut_lineage(state.filter(F.col("split").isNotNull()).unionByName(rest))
            break
        wants = scan(_demand(undecided, keys), [*keys, "amount"], ["row_no"], [block_of("row_no")], {"run": Scan("sum", F.col("need"))})
        judged = wants.join(left, [*keys, "amount"], "left").withColumn("left", F.coalesce("left", F.lit(0)))
        verdict = judged.groupBy(*keys, "row_no").agg(
            F.bool_and(F.col("run") <= F.col("left")).alias("fits"), F.bool_or(F.col("left") < F.col("need")).alias("dry")
        )
        out = state.join(verdict, [*keys, "row_no"], "left")
        decided = F.when(F.col("split").isNotNull(), F.col("split")).when(F.col("fits"), True).when(F.col("dry"), False)
        state = cut_lineage(out.select(*state.columns[:-1], decided.alias("split")))
    flagged = ws.join(state.filter("split").select(*keys, "row_no", "split"), [*keys, "row_no"], "left")
    return flagged.withColumn("split", F.coalesce("split", F.lit(False)))


def _demand(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per amount a row needs; equal parts need two of it."""
    same = F.col("part_a") == F.col("part_b")
    one = lambda c, n: F.struct(F.col(c).alias("amount"), F.lit(n).alias("need"))
    parts = F.when(same, F.array(one("part_a", 2))).otherwise(F.array(one("part_a", 1), one("part_b", 1)))
    return rows.select(*keys, "row_no", F.explode(parts).alias("d")).select(*keys, "row_no", "d.amount", "d.need")


def _finish_groups(undecided: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Settle small groups in row order: sorted partitions stream through Arrow batches, and
    only the unit counts of the current key are kept."""
    unit = lambda c: (F.col(c) * 100).cast("bigint")
    a = left.select(*keys, F.col("amount").alias("part_a"), F.col("left").alias("have_a"))
    b = left.select(*keys, F.col("amount").alias("part_b"), F.col("left").alias("have_b"))
    rows = undecided.drop("split").join(a, [*keys, "part_a"], "left").join(b, [*keys, "part_b"], "left")
    rows = rows.fillna(0, ["have_a", "have_b"]).withColumns({"__a": unit("part_a"), "__b": unit("part_b")})
    types = dict(undecided.dtypes)
    names = [*keys, "row_no", "part_a", "part_b"]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", split boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pool = None, {}
        for pdf in batches:
            verdicts = []
            group = list(zip(*[pdf[k] for k in keys], strict=True))
            for key, x, y, hx, hy in zip(group, pdf["__a"], pdf["__b"], pdf.have_a, pdf.have_b, strict=True):
                if key != current:
                    current, pool = key, {}
                pool.setdefault(x, hx)
                pool.setdefault(y, hy)
                need = {x: 2} if x == y else {x: 1, y: 1}
                ok = all(pool[k] >= n for k, n in need.items())
                for k, n in need.items() if ok else ():
                    pool[k] -= n
                verdicts.append(ok)
            yield pdf[names].assign(split=verdicts)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "row_no").mapInPandas(run, schema)


def residual_report(ws: DataFrame, payments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unmatched non-zero worksheet rows and the earliest unexpected payments, side by side.

    Input rows carry direct and split; payments carry pay_date, amount, row_no.
    """
    done = ws.filter("direct").select(*keys, F.col("edd_total").alias("amount"), F.lit(1).alias("need"))
    halves = _demand(ws.filter("split").select(*keys, "row_no", F.col("ui_ett").alias("part_a"), F.col("p_i").alias("part_b")), keys)
    spent = done.unionByName(halves.select(*keys, "amount", "need")).groupBy(*keys, "amount").agg(F.sum("need").alias("__spent"))
    have = payments.groupBy(*keys, "amount").agg(F.count("*").alias("__have"))
    ranked = number_rows(payments, [*keys, "amount"], ["row_no"], [spread_of("row_no")], "__rn")
    # The report keeps the first (count left) payments of an amount in source order.
    extra = (
        ranked.join(have, [*keys, "amount"])
        .join(spent, [*keys, "amount"], "left")
        .filter(F.col("__rn") <= F.col("__have") - F.coalesce("__spent", F.lit(0)))
        .select(*keys, F.lit("unexpected").alias("side"), F.col("pay_date").alias("date"), "amount")
    )
    missing = ws.filter(~F.col("direct") & ~F.col("split") & (F.col("edd_total") != 0)).select(
        *keys, F.lit("missing").alias("side"), "date", F.col("edd_total").alias("amount")
    )
    return missing.unionByName(extra)


def edd_totals_agree(ws: DataFrame, payments: DataFrame, keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """(keys, agree): equal totals pass; strict also asks for equal amounts one by one."""
    a = ws.groupBy(*keys).agg(F.sum("edd_total").alias("__w"))
    b = payments.groupBy(*keys).agg(F.sum("amount").alias("__p"))
    zero = F.lit(0).cast(MONEY)
    out = a.join(b, list(keys), "full_outer").select(
        *keys, (F.coalesce("__w", zero) == F.coalesce("__p", zero)).alias("agree")
    )
    if not strict:
        return out
    left = ws.filter(F.col("edd_total") != 0).select(*keys, F.col("edd_total").alias("amount"))
    bad = multiset_counts(left, payments.select(*keys, "amount"), [*keys, "amount"]).filter("missing + extra > 0")
    off = bad.select(*keys).distinct().withColumn("__off", F.lit(True))
    return out.join(off, list(keys), "left").select(*keys, (F.col("agree") & F.col("__off").isNull()).alias("agree"))


def reconciliation_summary(flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """PASS / REVIEW per side and overall, from rows of (keys, side, n_issues)."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n_issues"))), F.lit(0))
    out = flags.groupBy(*keys).agg(side("federal").alias("federal_issues"), side("state").alias("state_issues"))
    word = lambda c: F.when(F.col(c) == 0, "PASS").otherwise("REVIEW")
    both = (F.col("federal_issues") == 0) & (F.col("state_issues") == 0)
    return (
        out.withColumn("federal", word("federal_issues"))
        .withColumn("state", word("state_issues"))
        .withColumn("overall", F.when(both, "PASSED").otherwise("NEEDS REVIEW"))
    )


def reconcile(ws: DataFrame, federal: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole check for every key: returns, per-date amounts, totals, state rows, verdict."""
    effective, returns = cancel_returned_payments(federal, keys)
    returns = returns_repaid(returns, effective, keys)
    flagged = flag_returned_worksheet_rows(ws, returns, keys)
    dates = multiset_diff(flagged, effective, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    sums = sum_checks(flagged, effective, returns, keys).select(
        *keys, (F.when(F.col("paid_ok"), 0).otherwise(1) + F.when(F.col("returned_ok"), 0).otherwise(1)).cast("bigint").alias("n")
    )
    unpaid = returns.filter(~F.col("repaid")).groupBy(*keys).agg(F.count("*").alias("n"))
    agree = edd_totals_agree(ws, state, keys)
    open_ws = ws.join(agree.filter(~F.col("agree")), list(keys), "left_semi")
    open_pay = state.join(agree.filter(~F.col("agree")), list(keys), "left_semi")
    split = match_split_pairs(match_direct(open_ws, open_pay, keys), open_pay, keys)
    left = residual_report(split, open_pay, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    off = agree.select(*keys, F.when(F.col("agree"), 0).otherwise(1).cast("bigint").alias("n"))
    tag = lambda df, s: df.select(*keys, F.lit(s).alias("side"), F.col("n").alias("n_issues"))
    parts = [tag(d, "federal") for d in (dates, sums, unpaid)] + [tag(d, "state") for d in (left, off)]
    flags = parts[0]
    for part in parts[1:]:
        flags = flags.unionByName(part)
    return reconciliation_summary(flags, keys)

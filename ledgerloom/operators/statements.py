"""Statement text lines to transactions, for every document and layout in one job.

Per-document state machines become ordered scans over (doc_id, pos): the section is
carried forward, a running sum of record starts numbers the records, and one
aggregation assembles each record.  Scans are chunked, so a document holding a large
share of all lines is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_number, safe_date, wide_year
from ledgerloom.functions.money import MONEY, money_parse
from ledgerloom.functions.text import blank, let, matched, merchant_location
from ledgerloom.operators.profiles import BY_NAME, ISSUER_RULES, MONTH_NAME, PROFILES, Profile
from ledgerloom.plans.ordered import Scan, block_of, first_per_key, fits, number_rows, scan
from ledgerloom.plans.session import cut_lineage

TX_COLUMNS = (
    "Date", "Transaction Date", "Description", "Merchant", "City", "State",
    "Reference Number", "Check Number", "Account Number", "Amount", "Payee",
)
CARD_CREDIT_WORDS = r"(?i)return|refund| cr |\bcr$|payment.*thank you|thank you.*payment|mobile payment"
# Words that mean money in when a statement prints no balance.
DEPOSIT_WORDS = r"(?i)ELECTRONIC CREDIT|MISC DEPOSIT|ATM DEPOSIT|CHECK REVERSAL|SERV CHARGE REV"
# Lines a task sorts at most, about, where documents are dealt out whole.
TASK_LINES = 1 << 19


def text_to_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, pos, text): trimmed non-blank lines; pos is dense, line_no counts blanks."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "[\t ]+", " ")
    numbered = F.transform(F.split(body, "\n"), lambda t, i: F.struct(i.alias("line_no"), F.trim(t).alias("text")))
    kept = F.filter(numbered, lambda s: s["text"] != "")
    others = [c for c in docs.columns if c not in (doc_id, text)]
    out = docs.select(F.col(doc_id).alias("doc_id"), *others, F.posexplode(kept).alias("pos", "__line"))
    return out.select("doc_id", *others, "__line.line_no", "pos", "__line.text")


def classify_document(docs: DataFrame, file_name: str | None = None) -> DataFrame:
    """Add `profile`: issuer words in the whole text decide, most specific first; file-name hints come last."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    name = F.lower(blank(file_name)) if file_name else F.lit("")

    def hit(word: str) -> Column:
        return name.contains(word[5:]) if word.startswith("file:") else low.contains(word)

    def any_of(word_list: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in word_list:
            out = out | hit(word)
        return out

    verdict = F.lit(None).cast("string")
    for issuer, kinds in reversed(ISSUER_RULES):
        inner = F.lit(None).cast("string")
        for marks, profile in reversed(kinds):
            inner = F.lit(profile) if not marks else F.when(any_of(marks), profile).otherwise(inner)
        verdict = F.when(any_of(issuer), inner).otherwise(verdict)
    return docs.withColumn("profile", verdict)


def _by_profile(pick: Callable[[Profile], Column | None], default: Column, only: str | None = None) -> Column:
    out = default
    for p in PROFILES:
        if only and p.layout != only:
            continue
        value = pick(p)
        if value is not None:
            out = F.when(F.col("profile") == p.name, value).otherwise(out)
    return out


def _pattern(attr: str) -> Column:
    """The profile's pattern as a column. regexp_extract keeps the last compiled pattern, and
    the lines of a document arrive together, so this stays one matcher instead of one per profile."""
    value = lambda p: F.lit(getattr(p, attr)) if getattr(p, attr) else None
    return _by_profile(value, F.lit(None).cast("string"))


def _found(pattern: Column, group: int | Column = 1) -> Column:
    """Matched group, or null when the pattern is missing or does not match."""
    group = F.lit(group) if isinstance(group, int) else group
    return F.nullif(F.call_function("regexp_extract", F.col("text"), pattern, group), F.lit(""))


def mark_lines(lines: DataFrame) -> DataFrame:
    """Add what each line is under its document's profile. Row-local, no shuffle."""
    section = F.when(_found(_pattern("end"), 0).isNotNull(), "")
    for i in reversed(range(max(len(p.sections) for p in PROFILES))):
        nth = lambda p, k, i=i: F.lit(p.sections[i][k]) if len(p.sections) > i else None
        none = F.lit(None).cast("string")
        header = _by_profile(lambda p: nth(p, 1), none)
        section = F.when(_found(header, 0).isNotNull(), _by_profile(lambda p: nth(p, 0), none)).otherwise(section)
    marked = lines.select(
        "*",
        section.alias("mk_section"),
        _found(_pattern("noise"), 0).isNotNull().alias("is_noise"),
        _found(_pattern("ref"), 0).isNotNull().alias("is_ref"),
        _found(_pattern("amount")).alias("amount_text"),
        _found(_pattern("start")).alias("date_text"),
    )
    plain = ~F.col("is_noise") & F.col("mk_section").isNull()
    return marked.withColumn("is_amount", plain & F.col("amount_text").isNotNull()).withColumn(
        "is_start", plain & F.col("date_text").isNotNull()
    )


def _chunks(short: bool, pos: str = "pos") -> list | None:
    """No chunks where the caller has seen that every document fits one."""
    return None if short else [block_of(pos)]


def deal_documents(lines: DataFrame, total: int) -> DataFrame:
    """Lines dealt out by document to as many tasks as `total` lines ask for; scans, groups and joins by document stay there.

    The session's own number of shuffle partitions serves where it is larger.
    """
    tasks = -(-total // TASK_LINES)
    own = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(tasks, "doc_id") if tasks > own else lines


def tag_sections(marked: DataFrame, short: bool = False) -> DataFrame:
    """Carry the last section header down; an end marker clears it."""
    out = scan(marked, ["doc_id"], ["pos"], _chunks(short), {"section": Scan("last", F.col("mk_section"))}, near=True)
    return out.withColumn("section", F.coalesce("section", F.lit("")))


def drop_noise_lines(marked: DataFrame) -> DataFrame:
    """Remove page furniture, headers and totals."""
    return marked.filter(~F.col("is_noise") & F.col("mk_section").isNull())


def _wanted(profiles: tuple[str, ...]) -> Column:
    return F.col("profile").isin(*profiles) if profiles else F.lit(False)


def _needs(attr: str) -> Column:
    return F.col("profile").isin(*[p.name for p in PROFILES if getattr(p, attr)])


def _joined(rows: Column) -> Column:
    ordered = F.sort_array(rows)
    return F.trim(F.array_join(F.transform(ordered, lambda r: r["text"]), " "))


def _in_checks() -> Column:
    """Whether a line or record of a section is one of checks that their numbers begin."""
    return _needs("checks") & (F.col("section") == "checks")


def begin_checks(marked: DataFrame, short: bool = False) -> DataFrame:
    """Add sections; in check sections of profiles with check numbers the number line is the start, and no amount."""
    tagged = tag_sections(marked, short)
    if short:
        # in the order of the other scans, so all use one sort
        tagged = tagged.withColumn("__dated", F.lead("is_start").over(Window.partitionBy("doc_id").orderBy("pos")))
    else:
        rev = tagged.withColumn("__back", -F.col("pos"))
        tagged = scan(rev, ["doc_id"], ["__back"], [block_of("__back")], {"__dated": Scan("prev_last", F.col("is_start"))}, near=True).drop("__back")
    number = _by_profile(lambda p: F.lit(p.checks[1]) if p.checks else None, F.lit(None).cast("string"))
    # A bare number is a check only when a date follows it; a prefixed one always is.
    follows = F.coalesce("__dated", F.lit(False)) | ~_needs("check_before_date")
    anchor = F.col("mk_section").isNull() & ~F.col("is_noise") & follows & F.when(_in_checks(), _found(number)).isNotNull()
    return tagged.withColumns(
        {"is_start": F.when(_in_checks(), anchor).otherwise(F.col("is_start")), "is_amount": F.col("is_amount") & ~anchor}
    ).drop("__dated")


def assemble_blocks(marked: DataFrame, checks: bool = False, short: bool | None = None) -> DataFrame:
    """Records that begin at their date (or check-number) line and end at their amount.

    Lines after the amount belong to the record only under layouts with a trailing
    description.  In long documents records without an amount are dropped before anything is
    collected, so a date that no amount follows does not gather the rest of its document.
    `checks` says that records of check sections begin at their number; no record leaves its
    section, so one pass serves both kinds.  `short` says whether every document fits a
    chunk, and is looked up if not given.
    """
    if short is None:
        short = fits(marked, ["doc_id"], [block_of("pos")])
    ends = _needs("ref_ends") & F.col("is_ref")
    # Furniture that begins and ends nothing is done with, unless a number line looks at its next line.
    used = ~F.col("is_noise") | F.col("mk_section").isNotNull() | ends
    lines = marked.filter(used | _needs("check_before_date") if checks else used)
    if checks:
        lines = begin_checks(lines, short)
    begin = F.col("is_start")
    boundary = begin | F.col("mk_section").isNotNull()
    state = (
        F.when(begin, "open")
        .when(F.col("mk_section").isNotNull(), "none")
        .when(F.col("is_amount"), "closed")
        .when(ends, "none")
    )
    specs = {"block": Scan("sum", F.when(boundary, 1).otherwise(0)), "before": Scan("prev_last", state)}
    if not checks:
        specs["section"] = Scan("last", F.col("mk_section"))
    found = scan(lines, ["doc_id"], ["pos"], _chunks(short), specs, near=True).withColumn("section", F.coalesce("section", F.lit("")))
    in_section = (F.col("section") != "") | ~_needs("needs_section")
    open_row = begin | (F.col("before") == "open") | (_needs("tail") & (F.col("before") == "closed"))
    rows = found.filter(~F.col("is_noise") & F.col("mk_section").isNull() & in_section & F.coalesce(open_row, F.lit(False)))
    if short:
        rows = rows.filter(F.col("doc_id").isNotNull())
    else:
        rows = rows.join(rows.filter("is_amount").select("doc_id", "block").distinct(), ["doc_id", "block"], "left_semi")
    inside = ~begin & ~F.col("is_amount")
    printed_ref = F.col("is_ref") & _needs("ref_ends")
    line = F.struct("pos", "text")
    out = rows.groupBy("doc_id", "profile", "block").agg(
        F.min("pos").alias("line_no"),
        F.max("section").alias("section"),
        F.min_by(F.coalesce("date_text", "text"), F.when(begin, F.col("pos"))).alias("start_text"),
        F.min_by("text", F.when(begin, F.col("pos"))).alias("start_line"),
        F.min_by("date_text", F.when(F.col("date_text").isNotNull(), F.col("pos"))).alias("date_raw"),
        F.min_by("amount_text", F.when(F.col("is_amount"), F.col("pos"))).alias("amount_text"),
        F.sort_array(F.collect_list(F.when(F.col("is_amount"), F.struct("pos", "amount_text")))).alias("__amounts"),
        F.collect_list(F.when(inside & ~printed_ref, line)).alias("__text"),
        F.min_by("text", F.when(printed_ref, F.col("pos"))).alias("ref_line"),
    )
    rest = F.trim(F.substr(F.col("start_line"), F.length("start_text") + 1))
    lead = F.nullif(F.when(~_in_checks(), rest) if checks else rest, F.lit(""))
    body = F.concat_ws(" ", lead, F.nullif(_joined(F.col("__text")), F.lit("")))
    return out.filter(F.col("amount_text").isNotNull()).select(
        "doc_id",
        "profile",
        "section",
        "line_no",
        "start_text",
        "date_raw",
        F.coalesce(F.nullif(body, F.lit("")), "ref_line", F.lit("")).alias("description"),
        money_parse("amount_text").alias("amount"),
        money_parse(F.try_element_at("__amounts", F.lit(2))["amount_text"]).alias("balance"),
        F.lit("").alias("reference"),
    )


def assemble_blocks_backward(marked: DataFrame, short: bool = False) -> DataFrame:
    """Records closed by their amount line; text above it, back to the previous break, describes it."""
    sectioned = tag_sections(marked, short)
    breaks = F.col("is_amount") | F.col("is_noise") | (F.col("is_ref") & ~_needs("lookback"))
    breaks = F.when(_needs("lookback"), F.col("is_amount")).otherwise(breaks)
    closing = F.when(
        breaks, F.struct("pos", "line_no", F.col("is_amount").alias("pays"), "section", F.upper("text").endswith("CR").alias("cr"))
    )
    # Furniture and headers that break nothing are done with.
    body = ~F.col("is_noise") & F.col("mk_section").isNull()
    rev = sectioned.filter(breaks | body).withColumn("__back", -F.col("pos"))
    found = scan(rev, ["doc_id"], ["__back"], _chunks(short, "__back"), {"closer": Scan("last", closing)}, near=True)
    reach = F.lit(None).cast("int")
    for p in PROFILES:
        if p.lookback:
            reach = F.when(F.col("profile") == p.name, p.lookback).otherwise(reach)
    near = reach.isNull() | (F.col("closer.line_no") - F.col("line_no") <= reach)
    in_section = (F.col("closer.section") != "") | ~_needs("needs_section")
    rows = found.filter(F.col("closer.pays") & near & in_section & body)
    dated = F.col("date_text").isNotNull()
    card_ref = F.col("is_ref") & _needs("lookback")
    text = ~F.col("is_amount") & ~(dated & _needs("lookback")) & ~card_ref
    out = rows.groupBy("doc_id", "profile", F.col("closer.pos").alias("line_no")).agg(
        F.max("closer.section").alias("section"),
        F.max("closer.cr").alias("printed_credit"),
        F.max_by("date_text", F.when(dated, F.col("pos"))).alias("date_raw"),
        F.max_by("amount_text", F.when(F.col("is_amount"), F.col("pos"))).alias("amount_text"),
        F.max_by("text", F.when(card_ref, F.col("pos"))).alias("ref_line"),
        F.sort_array(F.collect_list(F.when(dated & _needs("lookback"), F.col("pos"))), False).alias("__dates"),
        F.collect_list(F.when(text, F.struct("pos", "text"))).alias("__text"),
    )
    # With two dates above the amount, the upper one (the posting date) starts the record.
    posted = F.coalesce(F.try_element_at("__dates", F.lit(2)), F.lit(-1))
    body = F.filter("__text", lambda r: r["pos"] > posted)
    return out.select(
        "doc_id", "profile", "section", "line_no", "date_raw",
        F.nullif(_joined(body), F.lit("")).alias("description"),
        money_parse("amount_text").alias("amount"),
        F.lit(None).cast(MONEY).alias("balance"),
        F.coalesce("ref_line", F.lit("")).alias("reference"),
        "printed_credit",
    ).filter(F.col("description").isNotNull() & F.col("date_raw").isNotNull())


def parse_fixed_layout(marked: DataFrame, short: bool = False) -> DataFrame:
    """Five-line records: posted, transaction date, description, long reference, amount."""
    date_here = F.when(F.col("is_start"), F.struct("pos", "date_text"))
    found = scan(
        marked,
        ["doc_id"],
        ["pos"],
        _chunks(short),
        {
            "section": Scan("last", F.col("mk_section")),
            "second": Scan("last", date_here),
            "first": Scan("prev_last", date_here),
        },
        near=True,
    )
    # On a second date line `first` is the line before it; below, it is the second itself.
    offset = F.col("pos") - F.col("second.pos")
    rows = found.filter((F.coalesce("section", F.lit("")) != "") & offset.between(0, 3) & F.col("mk_section").isNull())
    pair = (F.col("first.pos") == F.col("pos") - 1) & F.col("is_start")
    got = lambda i, ok, value: F.max(F.when((offset == i) & ok, value))
    out = rows.groupBy("doc_id", "profile", F.col("second.pos").alias("line_no")).agg(
        F.max("section").alias("section"),
        F.max(F.when(offset == 0, F.when(pair, F.col("first.date_text")))).alias("date_raw"),
        got(0, F.lit(True), F.col("date_text")).alias("tx_date_raw"),
        got(1, F.lit(True), F.col("text")).alias("description"),
        got(2, F.col("is_ref"), F.col("text")).alias("reference"),
        got(3, F.col("is_amount"), F.col("amount_text")).alias("amount_text"),
    )
    complete = F.col("date_raw").isNotNull() & F.col("reference").isNotNull() & F.col("amount_text").isNotNull()
    return out.filter(complete).select(
        "doc_id", "profile", "section", "line_no", "date_raw", "tx_date_raw", "description",
        money_parse("amount_text").alias("amount"), "reference",
    )


def parse_single_line(marked: DataFrame, short: bool = False) -> DataFrame:
    """One-line records by profile pattern, inside the wanted sections."""
    pattern = _pattern("single")
    hit = _found(pattern, 0).isNotNull()
    # Other lines neither set a section nor are records.
    sectioned = tag_sections(marked.filter(hit | F.col("mk_section").isNotNull()), short)

    def part(name: str) -> Column:
        group = lambda p: F.lit(p.single_fields.index(name) + 1) if name in p.single_fields else None
        has = F.col("profile").isin(*[p.name for p in PROFILES if name in p.single_fields])
        return F.when(has, _found(pattern, _by_profile(group, F.lit(0))))

    keep = ~F.col("is_noise") & ((F.col("section") != "") | ~_needs("needs_section"))
    record = F.struct(
        part("date").alias("date_raw"), part("tx_date").alias("tx_date_raw"),
        F.trim(part("description")).alias("description"),
        money_parse(part("amount")).alias("amount"),
        money_parse(part("balance")).alias("balance"),
        F.coalesce(part("reference"), F.lit("")).alias("reference"),
    )
    # A line without a match has no amount either. As a list of one the record is read once, not again by the filter.
    paid = F.filter(F.array(record), lambda r: r["amount"].isNotNull())
    return sectioned.filter(keep).select("doc_id", "profile", "section", F.col("pos").alias("line_no"), F.inline(paid))


def title_checks(records: DataFrame) -> DataFrame:
    """Check numbers: of bare numbers in check sections, and of records that a number line began, with payee and reference."""
    ours = _in_checks()
    own = F.regexp_extract("start_text", r"(\d+)", 1)
    bare = F.when(F.col("section") == "checks", F.nullif(F.regexp_extract("description", r"^(\d{4,})\*?$", 1), F.lit("")))
    payee = F.trim(F.regexp_replace("description", rf"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s*\d{{1,2}}\b|\b[A-Z]*\d{{7,}}\*?", ""))
    reference = F.regexp_extract("description", r"\b([A-Z]*\d{7,})\*?", 1)
    numbered = records.filter(~ours | F.col("date_raw").isNotNull()).withColumn("check_number", F.when(ours, own).otherwise(bare))
    return numbered.select(
        "doc_id", "profile", "section", "line_no", "date_raw",
        F.when(F.col("check_number").isNotNull(), F.concat(F.lit("Check "), "check_number")).otherwise(F.col("description")).alias("description"),
        F.when(ours, -F.abs("amount")).otherwise(F.col("amount")).cast(MONEY).alias("amount"),
        F.when(~ours, F.col("balance")).alias("balance"),
        F.when(ours, reference).otherwise(F.col("reference")).alias("reference"),
        "check_number", F.when(ours, payee).alias("payee"),
    )


def parse_fees_interest(marked: DataFrame, tx: DataFrame, period: DataFrame) -> DataFrame:
    """Interest rows dated at the period close, unless an equal row was already parsed."""
    money = F.regexp_extract("text", r"^\s*-?\s*\$([\d,]+\.\d{2})\s*$", 1)
    label = F.when(F.lower("text").startswith("interest charge on"), F.struct("pos", "text"))
    found = scan(
        marked.filter(F.col("profile") == "card_billing"),
        ["doc_id"],
        ["pos"],
        [block_of("pos")],
        {"section": Scan("last", F.col("mk_section")), "label": Scan("prev_last", label)},
        near=True,
    )
    rows = found.filter(
        (F.col("section") == "interest") & (F.col("label.pos") == F.col("pos") - 1) & (money != "")
    ).select("doc_id", "profile", F.col("pos").alias("line_no"), F.col("label.text").alias("description"), money_parse(money).alias("__amt"))
    rows = rows.filter(F.col("__amt") > 0).withColumn("__low", F.lower("description"))
    same = tx.select("doc_id", F.lower("description").alias("__low"), F.abs("amount").cast(MONEY).alias("__amt")).distinct()
    fresh = rows.join(same, ["doc_id", "__low", "__amt"], "left_anti")
    return fresh.join(period.select("doc_id", "end_date"), "doc_id", "left").select(
        "doc_id", "profile", F.lit("interest").alias("section"), "line_no", "description",
        F.col("end_date").alias("tx_date"), (-F.col("__amt")).cast(MONEY).alias("amount"),
    )


def split_by_summary_counts(records: DataFrame, summary: DataFrame, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sections by item counts: first n_customer, then n_other, then withdrawals, then checks.

    Also returns one expected-versus-found row per document, because a wrong count shifts
    everything after it.  `short` says that every document fits a chunk.
    """
    ranked = number_rows(records, ["doc_id"], ["line_no"], _chunks(short, "line_no"), "rn")
    joined = ranked.join(summary, "doc_id", "left")
    n1, n2, n3 = F.col("n_customer"), F.col("n_other_dep"), F.col("n_other_wdr")
    section = (
        F.when(F.col("rn") <= n1, "customer_deposit")
        .when(F.col("rn") <= n1 + n2, "other_deposit")
        .when(F.col("rn") <= n1 + n2 + n3, "withdrawal")
        .when(F.col("rn") <= n1 + n2 + n3 + F.col("n_checks"), "check")
    )
    credit = F.col("section").isin("customer_deposit", "other_deposit")
    out = (
        joined.withColumn("section", section)
        .filter(F.col("section").isNotNull())
        .withColumn("amount", F.when(credit, F.abs("amount")).otherwise(-F.abs("amount")).cast(MONEY))
        .drop("n_customer", "n_other_dep", "n_other_wdr", "n_checks", "rn")
    )
    found = records.groupBy("doc_id").agg(F.count("*").alias("found"))
    expected = (n1 + n2 + n3 + F.col("n_checks")).cast("bigint").alias("expected")
    quality = summary.join(found, "doc_id", "left").select("doc_id", expected, F.coalesce("found", F.lit(0)).alias("found"))
    return out, quality


def summary_counts(lines: DataFrame, short: bool = False) -> DataFrame:
    """Item counts of the account summary: on the header line or one of the next three."""
    after = scan(
        lines,
        ["doc_id"],
        ["pos"],
        _chunks(short),
        {
            "opened": Scan("last", F.when(F.lower("text").startswith("beginning balance on"), F.col("pos"))),
        },
        near=True,
    ).filter(F.col("opened").isNotNull() & (F.col("pos") - F.col("opened")).between(0, 28))
    low = F.lower("text")
    kind = (
        F.when(low.contains("customer deposits") & ~low.contains("other"), "n_customer")
        .when(low.contains("other deposits") & ~low.contains("withdrawal"), "n_other_dep")
        .when(low.contains("other withdrawals"), "n_other_wdr")
        .when(low.contains("checks paid") | low.contains("checks presented"), "n_checks")
    )
    # At most 29 lines of a summary reach this point, so the rows of one document are few;
    # lines that are neither a kind nor a number are not looked at below, the opening line keeps its document.
    told = kind.isNotNull() | F.replace("text", F.lit(","), F.lit("")).rlike(r"^\d+$") | (F.col("pos") == F.col("opened"))
    rows = after.filter(told).select("doc_id", "pos", kind.alias("kind"), "text").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("rows")
    )

    def count_of(name: str) -> Column:
        def number(r: Column) -> Column:
            own = F.nullif(F.regexp_extract(r["text"], r"\b(\d+)\b", 1), F.lit(""))
            near = F.filter(F.col("rows"), lambda o: (o["pos"] > r["pos"]) & (o["pos"] <= r["pos"] + 3) & F.replace(o["text"], F.lit(","), F.lit("")).rlike(r"^\d+$"))
            return F.coalesce(own, F.replace(F.try_element_at(near, F.lit(1))["text"], F.lit(","), F.lit("")))

        hits = F.filter(F.col("rows"), lambda r: r["kind"] == name)
        values = F.filter(F.transform(hits, number), lambda v: v.isNotNull())
        return F.coalesce(F.try_element_at(values, F.lit(-1)).try_cast("int"), F.lit(0)).alias(name)

    return rows.select("doc_id", *[count_of(n) for n in ("n_customer", "n_other_dep", "n_other_wdr", "n_checks")])


def statement_period(lines: DataFrame, year_max: int = 2035) -> DataFrame:
    """(start_month, start_year, end_month, end_year, end_date) per document by pattern priority.

    Dates may be printed over two lines, so a document's lines are put together again; that is
    no more than the row its text came in.
    """
    top = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows")
    )
    top = top.select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("head"))
    t = F.col("head")
    sane = lambda y: y.between(1990, year_max)
    slash = r"(?i)(\d{1,2})/(\d{1,2})/(\d{4})\s*(?:-|through|to)\s*(\d{1,2})/(\d{1,2})/(\d{4})"
    openclose = r"(?i)Open\s+Date:\s*(\d{1,2})/(\d{1,2})/(\d{4}).*?Closing\s+Date:\s*(\d{1,2})/(\d{1,2})/(\d{4})"
    abbr = r"([A-Z][a-z]{2})\s+(\d{1,2}),\s+(\d{4})\s*(?:-|through)\s*([A-Z][a-z]{2})\s+(\d{1,2}),\s+(\d{4})"
    long = rf"(?i)({MONTH_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})\s+(?:to|through)\s+({MONTH_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    number = lambda v: v.try_cast("int")

    def found(p: str, fields: Callable[[Callable[[int], Column]], Column]) -> Column:
        """The fields of a pattern's first match; the document is searched once, its groups are read from the match."""
        return let(F.regexp_extract(t, p, 0), lambda hit: F.when(hit != "", fields(lambda i: F.regexp_extract(hit, p, i))))

    def span(p: str, month: Callable) -> Column:
        def fields(at: Callable[[int], Column]) -> Column:
            got = F.struct(
                month(at(1)).alias("start_month"), number(at(3)).alias("start_year"), month(at(4)).alias("end_month"),
                number(at(6)).alias("end_year"), safe_date(number(at(6)), month(at(4)), number(at(5))).alias("end_date"),
            )
            return F.when(sane(number(at(3))) & sane(number(at(6))), got)

        return found(p, fields)

    def closing(p: str) -> Column:
        def fields(at: Callable[[int], Column]) -> Column:
            none = F.lit(None).cast("int")
            got = F.struct(
                none.alias("start_month"), none.alias("start_year"), number(at(1)).alias("end_month"),
                number(at(3)).alias("end_year"), safe_date(number(at(3)), number(at(1)), number(at(2))).alias("end_date"),
            )
            return F.when(sane(number(at(3))), got)

        return found(p, fields)

    ends = [
        rf"(?i){word}\s+(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})"
        for word in ("through", r"as\s+of", r"statement\s+ending", r"statement\s+date")
    ]
    best = F.coalesce(
        span(openclose, number), span(slash, number), span(abbr, month_number), span(long, month_number), *[closing(p) for p in ends]
    )
    year = lambda p: number(matched(t, p))
    spare = F.coalesce(
        year(rf"(?i)statement\s+period.*?(\d{{4}})"),
        year(rf"(?i){MONTH_NAME}\s+\d{{1,2}},?\s+(\d{{4}})"),
        year(r"\d{1,2}/\d{1,2}/(\d{4})"),
        year(r"\b(20\d{2})\b"),
    )
    # The spare year is looked for only where no period ends.
    return (
        top.select("doc_id", "head", best.alias("p"))
        .select("doc_id", "p", F.when(F.col("p.end_year").isNull(), spare).alias("spare"))
        .select("doc_id", "p.*", F.coalesce("p.end_year", F.when(sane(F.col("spare")), F.col("spare"))).alias("statement_year"))
    )


def assign_year(tx: DataFrame, period: DataFrame, fallback_year: int = 2000) -> DataFrame:
    """Add `tx_date`; a period over a year end gives each month its own year."""
    raw = F.trim("date_raw")
    slash = r"^(\d{1,2})/(\d{1,2})(?:/(\d{2}|\d{4}))?$"
    named = r"^([A-Za-z]{3,})\s*(\d{1,2})$"
    number = lambda v: v.try_cast("int")
    fields = lambda m, d, y: F.struct(m.alias("month"), d.alias("day"), y.alias("printed"))
    # Read once, as a column: the year's rule names it several times.
    parts = let(
        raw,
        lambda t: F.when(t.rlike(slash), let(F.split(t, "/"), lambda p: fields(number(p[0]), number(p[1]), number(F.get(p, F.lit(2)))))).when(
            t.rlike(named), fields(month_number(t), number(F.regexp_extract(t, named, 2)), F.lit(None).cast("int"))
        ),
    )
    joined = tx.withColumn("__read", parts).join(period, "doc_id", "left")
    month = F.col("__read.month")
    spans = (F.col("start_year") != F.col("end_year")) & F.col("start_month").isNotNull()
    late = F.col("profile").isin(*[p.name for p in PROFILES if p.straddle == "start"])
    straddled = F.when(
        F.when(late, month >= F.col("start_month")).otherwise(month > F.col("end_month")), F.col("start_year")
    ).otherwise(F.col("end_year"))
    year = F.coalesce(
        wide_year(F.col("__read.printed"), 50),
        F.when(spans, straddled),
        F.col("end_year"),
        F.col("statement_year"),
        F.lit(fallback_year),
    )
    keep = [c for c in tx.columns]
    return joined.select(*keep, safe_date(year, month, F.col("__read.day")).alias("tx_date"))


def opening_balance(lines: DataFrame) -> DataFrame:
    """First printed beginning balance, on its own line or the next."""
    pattern = r"(?i)(?:Beginning|Opening|Previous|Prior)\s+Balance\s*[:$]?\s*\$?([\d,]+\.\d{2}-?)"
    bare = r"(?i)(?:Beginning|Opening|Previous|Prior)\s+Balance\s*:?\s*$"
    here = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    found = scan(lines, ["doc_id"], ["pos"], [block_of("pos")], {"__prior": Scan("prev_last", F.struct("pos", "text"))}, near=True)
    after = F.when(
        F.col("__prior.text").rlike(bare), F.nullif(F.regexp_extract("text", r"^\$?([\d,]+\.\d{2}-?)$", 1), F.lit(""))
    )
    # A same-line amount anywhere beats a next-line amount.
    rank = F.struct(F.when(here.isNotNull(), 0).otherwise(1), "pos")
    value = money_parse(F.coalesce(here, after))
    return found.filter(value.isNotNull()).groupBy("doc_id").agg(F.min_by(value, rank).alias("opening"))


def sign_by_balance(tx: DataFrame, opening: DataFrame) -> DataFrame:
    """Balance up means money in. Without opening or balances, deposit words decide."""
    seen = scan(
        tx,
        ["doc_id"],
        ["line_no"],
        [block_of("line_no")],
        {"__prev": Scan("prev_last", F.col("balance"))},
        near=True,
    ).join(opening, "doc_id", "left")
    has = tx.groupBy("doc_id").agg(F.count("balance").alias("__balances"))
    seen = seen.join(has, "doc_id", "left")
    prev = F.coalesce("__prev", "opening")
    usable = F.col("opening").isNotNull() & (F.col("__balances") > 0)
    size = F.abs("amount")
    by_balance = F.when(F.col("balance") > prev, size).otherwise(-size)
    by_words = F.when(F.col("description").rlike(DEPOSIT_WORDS), size).otherwise(-size)
    return seen.withColumn("amount", F.when(usable, by_balance).otherwise(by_words).cast(MONEY)).drop(
        "__prev", "opening", "__balances"
    )


def sign_by_section(tx: DataFrame) -> DataFrame:
    """Credits section, a printed CR mark or credit words mean money in."""
    size = F.abs("amount")
    words = (F.col("profile") == "card_open_close") & F.col("description").rlike(CARD_CREDIT_WORDS)
    printed = F.coalesce(F.col("printed_credit"), F.lit(False)) if "printed_credit" in tx.columns else F.lit(False)
    minus = (F.col("amount") < 0) & (F.col("profile") == "card_billing")
    return tx.withColumn(
        "amount", F.when((F.col("section") == "credits") | printed | words | minus, size).otherwise(-size).cast(MONEY)
    )


def extract_refs(tx: DataFrame) -> DataFrame:
    """Check number by ordered patterns, else a reference number, from the description."""
    d = F.coalesce(F.col("description"), F.lit(""))
    pick = lambda p: F.nullif(F.regexp_extract(d, p, 1), F.lit(""))
    check = F.when(
        d.rlike("(?i)CHE?C?K"),
        F.coalesce(pick(r"(?i)CHECK\s+NO\.?\s*:?\s*(\d+)"), pick(r"(?i)Check\s*#\s*(\d+)"), pick(r"(?i)CHK\s*#?\s*(\d+)")),
    )
    ref = F.coalesce(pick(r"\b#\s*(\d{3,8})\b"), pick(r"(?i)REF\s*[=#]?\s*([A-Z0-9]+)"))
    own_check = F.col("check_number") if "check_number" in tx.columns else F.lit(None).cast("string")
    own_ref = F.nullif(F.col("reference"), F.lit("")) if "reference" in tx.columns else F.lit(None).cast("string")
    number = F.coalesce(F.nullif(own_check, F.lit("")), check)
    # The number is found once, as a column; both results name it.
    numbered = tx.withColumn("__number", number).withColumns(
        {"check_number": F.coalesce("__number", F.lit("")), "reference": F.coalesce(own_ref, F.when(F.col("__number").isNull(), ref), F.lit(""))}
    )
    return numbered.drop("__number")


def split_merchant_location(tx: DataFrame) -> DataFrame:
    return tx.withColumns(merchant_location("description"))


def dedupe_transactions(tx: DataFrame, short: bool = False) -> DataFrame:
    """First row per (document, date, description, amount, reference); a window serves where documents are `short`."""
    keys = ["doc_id", "tx_date", "description", "amount", "reference"]
    if not short:
        return first_per_key(tx, keys, ["line_no"])
    return tx.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).filter("__rn = 1").drop("__rn")


def filter_direction(tx: DataFrame, direction: str = "both", respect_sign: bool = True) -> DataFrame:
    """debits are negative, credits positive; both keeps everything."""
    if direction == "both" or not respect_sign:
        return tx
    return tx.filter(F.col("amount") < 0 if direction == "debits" else F.col("amount") > 0)


def canonical_transactions(tx: DataFrame) -> DataFrame:
    """The eleven printed columns, blanks where a layout has no such field."""
    have = set(tx.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    shown = F.date_format("tx_date", "MM/dd/yyyy")
    merchant = F.col("merchant") if "merchant" in have else F.col("description")
    number = F.coalesce(F.nullif(text("check_number"), F.lit("")), F.when(text("section") == "checks", text("reference")), F.lit(""))
    values = (
        shown, shown, F.col("description"), merchant, text("city"), text("state"),
        text("reference"), number, text("account_number"), F.col("amount"), text("payee"),
    )
    return tx.select("doc_id", "line_no", *[v.alias(n) for v, n in zip(values, TX_COLUMNS, strict=True)])


def union_transactions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parse_statements(docs: DataFrame, profile: str | None = None) -> DataFrame:
    """Documents (doc_id, text, profile) to signed, dated transactions for every layout at once."""
    if profile:
        docs = docs.withColumn("profile", F.lit(profile))
    docs = docs.select("doc_id", "profile", "text").filter(F.col("profile").isNotNull())
    return parse_lines(text_to_lines(docs))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The same from a line table (doc_id, profile, line_no, pos, text).

    Marked lines feed several passes, so they are written once to the checkpoint folder;
    only the layouts that occur are planned.
    """
    marked = cut_lineage(mark_lines(lines))
    counts = {r["profile"]: r["count"] for r in marked.groupBy("profile").count().collect()}
    there = [BY_NAME[name] for name in counts if name in BY_NAME]
    if not there:
        return _no_rows(marked)

    def of(test: Callable[[Profile], bool]) -> tuple[str, ...]:
        return tuple(p.name for p in there if test(p))

    # One look at the positions tells all scans whether a document is longer than a chunk.
    short = fits(marked, ["doc_id"], [block_of("pos")])
    lines = deal_documents(marked, sum(counts.values())) if short else marked
    parts = []
    pending = lines
    if names := of(lambda p: p.single is not None):
        single = cut_lineage(parse_single_line(lines.filter(_wanted(names)), short))
        # Documents with one-line records need no assembly; without such records only the columns are kept,
        # so the other parts stay dealt out by document.  No layout makes a record without an amount line.
        read = single.select("doc_id").distinct()
        if single.isEmpty():
            single = single.limit(0)
        elif marked.filter("is_amount").select("doc_id").join(read, "doc_id", "left_anti").isEmpty():
            pending = marked.limit(0)
        else:
            pending = lines.join(read, "doc_id", "left_anti")
        parts.append(single)
    if names := of(lambda p: p.layout == "forward"):
        checks = bool(of(lambda p: p.checks is not None))
        parts.append(title_checks(assemble_blocks(pending.filter(_wanted(names)), checks, short)))
    if names := of(lambda p: p.layout == "backward"):
        parts.append(assemble_blocks_backward(pending.filter(_wanted(names)), short))
    if names := of(lambda p: p.layout == "fixed"):
        parts.append(parse_fixed_layout(pending.filter(_wanted(names)), short))

    period = statement_period(lines)
    dated = assign_year(union_transactions(*parts), period)
    rules = {
        "printed": lambda df: df,
        "inverted": lambda df: df.withColumn("amount", (-F.col("amount")).cast(MONEY)),
        "section": sign_by_section,
        "balance": lambda df: sign_by_balance(df, opening_balance(lines)),
    }
    used = {kind: of(lambda p, kind=kind: p.sign == kind) for kind in rules}
    used = {kind: names for kind, names in used.items() if names}
    if len(used) > 1 or "balance" in used:
        dated = cut_lineage(dated)
    signed = union_transactions(*[rules[kind](dated.filter(_wanted(names))) for kind, names in used.items()])
    if of(lambda p: p.name == "card_billing"):
        signed = union_transactions(signed, parse_fees_interest(lines, signed, period))
    return dedupe_transactions(extract_refs(signed), short)


def _no_rows(marked: DataFrame) -> DataFrame:
    schema = (
        "doc_id string, profile string, section string, line_no int, date_raw string, description string, "
        "amount decimal(18,2), reference string, check_number string, tx_date date"
    )
    return marked.sparkSession.createDataFrame([], schema)

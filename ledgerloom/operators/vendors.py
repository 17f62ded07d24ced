"""Vendor and account matching.

"Contained in" joins are equi-joins: each term is keyed by the three letters of it that the
fewest terms hold (a long term by sixteen, which few others hold however many terms there are),
each distinct text emits its runs of these lengths once, and a pair that meets is checked.  The
optimizer broadcasts a dictionary of up to 100,000 terms when its measured size allows and
shuffles otherwise; matches are ranked by aggregation, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.functions.text import compact, month_year_from_name, normalize_vendor_text, present, slugify, words
from ledgerloom.operators.columns import payee_columns
from ledgerloom.operators.similarity import ratio_candidates, sequence_ratio, token_set_candidates, token_set_score
from ledgerloom.plans.ordered import first_per_key
from ledgerloom.plans.session import cut_lineage

#: Letters of the runs that texts and terms meet by; a shorter term is its own key.
RUN = 3
#: The same for terms that have as many.
LONG_RUN = 16
#: A dictionary of more terms is never sent whole to every task: written it is far smaller than in memory.
BROADCAST_TERMS = 100_000
#: So many different runs are also listed in the plan, so that the other runs of a text never become rows.
LISTED_RUNS = 1_000


def build_vendor_dict(vendors: DataFrame, order: str | None = None) -> DataFrame:
    """(vendor, synonym, norm, rank key): the name and its aliases, normalized, blanks dropped.

    Equal-length synonyms rank by source row, then text.
    """
    row = F.col(order) if order else F.lit(0)
    lists = [F.split(F.col(c), r"[|;]") for c in ("Aliases", "Alias", "Keywords") if c in vendors.columns]
    base = F.trim("Vendor")
    every = F.concat(F.array(base), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    names = F.filter(F.array_distinct(F.transform(every, lambda e: F.trim(e))), lambda s: s != "")
    out = vendors.filter((base != "") & (F.lower(base) != "nan")).select(
        base.alias("vendor"), row.alias("vendor_row"), F.explode(names).alias("synonym")
    )
    out = out.withColumn("norm", normalize_vendor_text("synonym")).filter(F.col("norm") != "")
    return out.withColumn("norm_len", F.length("norm"))


def _runs(text: Column, k: int, only: Callable[[Column], Column] | None = None) -> Column:
    """Distinct runs of k characters, or those of them that pass `only`."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
    cut = F.filter(cut, only) if only else cut
    return F.when(n >= k, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def term_keys(terms: DataFrame, term: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, __run): the run of each distinct term that the fewest terms hold."""
    size = F.when(F.length(term) >= LONG_RUN, LONG_RUN).otherwise(F.least(F.length(term), F.lit(RUN)))
    by_size = [F.when(size == k, _runs(F.col(term), k)) for k in (*range(1, RUN + 1), LONG_RUN)]
    pieces = terms.filter(F.length(term) > 0).select(*keys, term).distinct().select(*keys, term, F.explode(F.coalesce(*by_size)).alias("__run"))
    held = pieces.groupBy("__run").agg(F.count("*").alias("__held"))
    return pieces.join(held, "__run").groupBy(*keys, term).agg(F.min(F.struct("__held", "__run"))["__run"].alias("__run"))


def contained_pairs(
    texts: DataFrame, text: str, terms: DataFrame, term: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows of (keys, text, every term column) for terms that occur inside the text; empty terms are inside none."""
    keyed = cut_lineage(term_keys(terms, term, keys))
    held = keyed.groupBy(F.length("__run")).count().collect()
    sizes = sorted(r[0] for r in held)
    if sum(r[1] for r in held) > BROADCAST_TERMS:
        keyed, terms = keyed.hint("merge"), terms.hint("merge")
    listed = [r[0] for r in keyed.select("__run").distinct().limit(LISTED_RUNS + 1).collect()]
    of_terms = (lambda run: run.isin(*listed)) if 0 < len(listed) <= LISTED_RUNS else None
    runs = F.flatten(F.array(*[_runs(F.col(text), k, of_terms) for k in sizes])) if sizes else F.array().cast("array<string>")
    probe = texts.select(*keys, text).distinct().select(*keys, text, F.explode(runs).alias("__run"))
    met = probe.join(keyed, [*keys, "__run"]).filter(F.contains(F.col(text), F.col(term))).drop("__run")
    return met.join(terms, [*keys, term])


def match_rules(tx: DataFrame, rules: DataFrame, text: str = "description", keys: Sequence[str] = ()) -> DataFrame:
    """Add `rule_vendor`: longest rule phrase inside the text, earlier rule on ties."""
    ready = rules.select(*keys, F.upper("phrase").alias("__phrase"), F.col("vendor").alias("__vendor"), "rule_no")
    ready = first_per_key(ready, [*keys, "__phrase"], ["rule_no"])
    upper = tx.withColumn("__text", F.upper(F.coalesce(F.col(text), F.lit(""))))
    best = (
        contained_pairs(upper, "__text", ready, "__phrase", keys)
        .groupBy(*keys, "__text")
        .agg(F.min_by("__vendor", F.struct(-F.length("__phrase"), F.col("rule_no"))).alias("rule_vendor"))
    )
    return upper.join(best, [*keys, "__text"], "left").drop("__text")


def _rank() -> Column:
    return F.struct((-F.col("norm_len")).alias("len"), F.col("vendor_row"), F.col("synonym"))


def match_vendor_contains(texts: DataFrame, dictionary: DataFrame, norm: str = "norm_text") -> DataFrame:
    """Distinct normalized texts with the longest dictionary entry inside them."""
    terms = first_per_key(dictionary, ["norm"], ["vendor_row", "synonym"])
    return (
        contained_pairs(texts.filter(F.col(norm) != ""), norm, terms, "norm")
        .groupBy(norm)
        .agg(F.min_by(F.col("vendor"), _rank()).alias("contains_vendor"))
    )


def match_vendor_fuzzy(
    texts: DataFrame, dictionary: DataFrame, norm: str = "norm_text", threshold: float = 0.8
) -> DataFrame:
    """Best similarity at or above the threshold, earlier entry on ties."""
    terms = first_per_key(dictionary, ["norm"], ["vendor_row", "synonym"])
    pairs = ratio_candidates(texts.filter(F.col(norm) != ""), terms, norm, "norm", threshold)
    scored = pairs.withColumn("ratio", sequence_ratio(F.col("norm"), F.col(norm))).filter(F.col("ratio") >= threshold)
    ranked = scored.join(terms, "norm")
    best = F.min_by(F.struct("vendor", "ratio"), F.struct((-F.col("ratio")).alias("r"), _rank()))
    return ranked.groupBy(norm).agg(best.alias("b")).select(
        norm, F.col("b.vendor").alias("fuzzy_vendor"), F.col("b.ratio").alias("ratio")
    )


def assign_vendor(
    tx: DataFrame,
    dictionary: DataFrame,
    rules: DataFrame | None = None,
    text: str = "description",
    keys: Sequence[str] = (),
    fuzzy: bool = True,
) -> DataFrame:
    """Payee text, else rule, else contained name, else similar name, else blank."""
    out = tx.withColumn("norm_text", normalize_vendor_text(text))
    out = match_rules(out, rules, text, keys) if rules is not None else out.withColumn("rule_vendor", F.lit(None).cast("string"))
    names = out.select("norm_text").distinct()
    contains = match_vendor_contains(names, dictionary)
    found = out.join(contains, "norm_text", "left")
    choices = [present("rule_vendor"), F.col("contains_vendor")]
    if "payee" in tx.columns:
        choices.insert(0, present("payee"))
    if fuzzy:
        residue = names.join(contains, "norm_text", "left_anti")
        similar = match_vendor_fuzzy(residue, dictionary).drop("ratio")
        found = found.join(similar, "norm_text", "left")
        choices.append(F.col("fuzzy_vendor"))
    out = found.withColumn("vendor", F.coalesce(*choices, F.lit("")))
    return out.drop("norm_text", "rule_vendor", "contains_vendor", "fuzzy_vendor")


def direction_of(amount: str | Column) -> Column:
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.when(a < 0, "debits").otherwise("credits")


def assign_account(tx: DataFrame, accounts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact (vendor, direction) lookup; a blank vendor gets a blank account."""
    if "direction" not in tx.columns:
        tx = tx.withColumn("direction", direction_of("amount"))
    named = accounts.filter(F.trim("vendor") != "")
    out = tx.join(named, [*keys, "vendor", "direction"], "left")
    return out.withColumn("account", F.coalesce("account", F.lit("")))


def shape_output(tx: DataFrame, direction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Import layout after `keys`: positive amounts, blank memo, column order by direction."""
    cols = {
        "Date": F.coalesce(F.date_format("tx_date", "MM/dd/yyyy"), F.lit("")),
        "Check Number": F.coalesce(F.col("check_number"), F.lit("")) if "check_number" in tx.columns else F.lit(""),
        "Vendor": F.col("vendor"),
        "Account": F.col("account"),
        "Amount": F.abs("amount").cast(MONEY),
        "Memo": F.lit(""),
    }
    order = (
        ("Date", "Vendor", "Account", "Memo", "Check Number", "Amount")
        if direction == "credits"
        else ("Date", "Check Number", "Vendor", "Account", "Amount", "Memo")
    )
    return tx.select(*keys, *[cols[c].alias(c) for c in order])


def last_transaction_month(tx: DataFrame, keys: Sequence[str] = (), file_name: str | None = None) -> DataFrame:
    """Month and year of the latest date per key, else of the file name's leading date."""
    aggs = [F.max("tx_date").alias("last_date")]
    if file_name:
        aggs.append(F.max(file_name).alias("__file"))
    out = tx.groupBy(*keys).agg(*aggs)
    month, year = F.month("last_date"), F.year("last_date")
    if file_name:
        m, y = month_year_from_name("__file")
        month, year = F.coalesce(month, m), F.coalesce(year, y)
    return out.select(*keys, "last_date", month.alias("month"), year.alias("year"))


def pick_vendor_list(companies: DataFrame, files: DataFrame, company: str = "company", path: str = "path") -> DataFrame:
    """(company, path): an exact candidate file name, else the first name holding the company.

    The loose rule is a substring equi-join, so no company meets every file.  Equal companies and
    equal file names are one row each, and spellings that are equal when compacted are matched
    once, so repeated rows do not multiply; sides that grow with the tables are joined by sorting.
    """
    files = files.groupBy(path).agg(F.lit(1).alias("__one"))
    companies = companies.groupBy(company).agg(F.lit(1).alias("__one"))
    base, slug = F.trim(company), slugify(company)
    names = [F.concat(base, F.lit(".csv")), F.concat(slug, F.lit(".csv")), F.concat(slug, F.lit("_vendor_list.csv"))]
    names += [F.concat(base, F.lit(".xlsx")), F.concat(slug, F.lit(".xlsx")), F.concat(slug, F.lit("_vendor_list.xlsx"))]
    listed = files.select(path, F.element_at(F.split(path, "/"), -1).alias("file"))
    best = F.min(F.struct("file", F.col(path).alias("path"))).alias("at")
    wanted = companies.select(company, F.posexplode(F.array(*names)).alias("prio", "file"))
    exact = wanted.join(listed.groupBy("file").agg(F.min(path).alias("path")).hint("merge"), "file")
    exact = exact.select(company, "prio", F.struct("file", "path").alias("at"))
    usable = listed.filter(F.lower("file").rlike(r"\.(csv|xlsx|xls)$")).withColumn("__flat", compact("file")).groupBy("__flat").agg(best)
    terms = companies.select(company, compact(company).alias("__want")).filter(F.col("__want") != "")
    met = contained_pairs(usable, "__flat", terms.select("__want").distinct(), "__want")
    loose = met.join(usable.hint("merge"), "__flat").groupBy("__want").agg(F.min("at").alias("at"))
    loose = terms.join(loose.hint("merge"), "__want").select(company, F.lit(100).alias("prio"), "at")
    picked = exact.unionByName(loose).groupBy(company).agg(F.min(F.struct("prio", "at")).alias("pick"))
    return picked.select(company, F.col("pick.at.path").alias(path))


def normalize_payee(x: str | Column) -> Column:
    s = F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9& ]+", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(s, r"\b(memo|dollars?)\b", ""))


def build_payee_dict(*sheets: DataFrame) -> DataFrame:
    """Normalized payee names from each sheet's best non-empty name column."""
    parts = []
    for sheet in sheets:
        groups = [g for g in payee_columns(sheet) if g]
        filled = sheet.agg(*[F.max(F.greatest(F.lit(0), *[F.when(present(c).isNotNull(), 1).otherwise(0) for c in g])).alias(f"g{i}") for i, g in enumerate(groups)]).first()
        chosen = next((g for i, g in enumerate(groups) if filled[f"g{i}"]), None)
        if chosen:
            cells = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in chosen])
            parts.append(sheet.select(F.explode(cells).alias("raw")))
    if not parts:
        raise ValueError("no text columns to read payees from")
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    names = raw.select(F.explode(words(F.col("raw"), r"[;/,\n]+")).alias("name"))
    return names.select(normalize_payee("name").alias("payee_norm")).filter(F.col("payee_norm") != "").distinct()


def _prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substr(text, F.lit(1), k))


def standardize_payee(checks: DataFrame, vendors: DataFrame, threshold: int = 90, payee: str = "payee") -> DataFrame:
    """Add `payee_std` and `payee_score`: exact 100, prefix either way 96, else token-set score.

    `vendors` holds payee_norm.  Several prefix hits resolve to the longest, then alphabetical.
    """
    names = cut_lineage(checks.select(normalize_payee(payee).alias("p")).filter(F.col("p") != "").distinct())
    terms = cut_lineage(vendors.select(F.col("payee_norm").alias("v")).distinct())
    exact = names.join(terms.withColumn("p", F.col("v")), "p").select("p", "v", F.lit(100).alias("score"))
    rest = names.join(exact, "p", "left_anti")
    longer = rest.select("p", F.explode(_prefixes(F.col("p"))).alias("v")).join(terms, "v")
    shorter = terms.select("v", F.explode(_prefixes(F.col("v"))).alias("p")).join(rest, "p")
    prefix = longer.select("p", "v").unionByName(shorter.select("p", "v")).distinct().withColumn("score", F.lit(96))
    prefix = cut_lineage(prefix)
    rest = cut_lineage(rest.join(prefix, "p", "left_anti"))
    fuzzy = token_set_candidates(rest, terms, "p", "v", float(threshold)).withColumn(
        "score", F.floor(token_set_score(F.col("p"), F.col("v"))).cast("int")
    )
    hits = exact.unionByName(prefix).unionByName(fuzzy.filter(F.col("score") >= threshold))
    best = hits.groupBy("p").agg(F.min_by(F.struct("v", "score"), F.struct(-F.col("score"), -F.length("v"), F.col("v"))).alias("b"))
    out = checks.withColumn("p", normalize_payee(payee)).join(best, "p", "left")
    return out.select(
        *checks.columns,
        F.coalesce("b.v", F.col(payee)).alias("payee_std"),
        F.coalesce("b.score", F.lit(0)).alias("payee_score"),
    )


def filter_min_amount(checks: DataFrame, minimum: float = 1000.0, amount: str = "amount") -> DataFrame:
    """Checks whose printed amount reaches the minimum."""
    value = F.regexp_replace(F.trim(amount), r"[$,]", "").try_cast(MONEY)
    return checks.filter(value >= F.lit(minimum).cast(MONEY))


def compare_company_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full comparison of (name, dba) on the left with (name) on the right, keyed by `doc_id`.

    Result is name, dba, none, left_only or right_only; blanks never match.
    """
    # Words spelled out before comparing.
    spelled = {"CORP": "CORPORATION", "INC": "INCORPORATED", "CO": "COMPANY", "LTD": "LIMITED", "PROF": "PROFESSIONAL"}
    table = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])

    def norm(c: str) -> Column:
        flat = F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^A-Za-z0-9_\s]", ""))
        return F.array_join(F.transform(words(F.trim(flat), r"\s+"), lambda w: F.coalesce(table[w], w)), " ")

    a = left.select("doc_id", norm("name").alias("name_norm"), norm("dba").alias("dba_norm"), F.lit(True).alias("__l"))
    b = right.select("doc_id", norm("name").alias("other_norm"), F.lit(True).alias("__r"))
    blank = F.col("other_norm") == ""
    verdict = (
        F.when(F.col("__r").isNull(), "left_only")
        .when(F.col("__l").isNull(), "right_only")
        .when(~blank & (F.col("name_norm") == F.col("other_norm")), "name")
        .when(~blank & (F.col("dba_norm") == F.col("other_norm")), "dba")
        .otherwise("none")
    )
    return a.join(b, "doc_id", "full_outer").select("doc_id", "name_norm", "dba_norm", "other_norm", verdict.alias("result"))


def payer_names(lines: DataFrame, kind: str) -> DataFrame:
    """Company name (and dba) printed on a paycheck, payroll, or tax-payment document."""
    from ledgerloom.plans.ordered import Scan, block_of, scan

    t = F.col("text")
    if kind == "payroll":
        top = lines.filter(F.col("pos") < 10).groupBy("doc_id").agg(
            F.min_by("text", F.struct(F.when(t.rlike("INC|LLC|CORP"), 0).otherwise(1), F.col("pos"))).alias("name")
        )
        return top.withColumn("dba", F.lit(""))
    mark = {"paycheck": "MEMO: Pay Period", "eftps": r"(?i)^TAXPAYER\s+NAME:"}[kind]
    found = scan(lines, ["doc_id"], ["pos"], [block_of("pos")], {"at": Scan("last", F.when(t.rlike(mark), F.struct("pos", "text")))})
    gap = F.col("pos") - F.col("at.pos")
    near = found.filter(gap.between(0, 4))
    at = lambda i, ok=None: F.min_by(F.when((gap == i) & (F.lit(True) if ok is None else ok), t), F.when((gap == i) & (F.lit(True) if ok is None else ok), F.col("pos")))
    if kind == "paycheck":
        out = near.groupBy("doc_id").agg(at(2).alias("name"), at(4, t.contains("DBA")).alias("dba"))
        return out.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("dba", F.lit("")).alias("dba"))
    same = F.trim(F.regexp_replace(t, r"(?i)^TAXPAYER\s+NAME:\s*", ""))
    out = near.groupBy("doc_id").agg(
        F.min_by(same, F.when(gap == 0, F.col("pos"))).alias("own"), at(1, ~t.rlike(r"(?i)^TIN\s*:")).alias("below")
    )
    return out.select("doc_id", F.coalesce(F.nullif("own", F.lit("")), "below", F.lit("")).alias("name"), F.lit("").alias("dba"))

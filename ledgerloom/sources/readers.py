"""Readers: practice files to typed tables. Every reader is one lazy plan over any number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_parse
from ledgerloom.functions.ids import digits
from ledgerloom.functions.money import MONEY, worksheet_money
from ledgerloom.functions.text import blank, person_name, present
from ledgerloom.operators.checklist import normalize_cell
from ledgerloom.operators.entities import dedupe_managers
from ledgerloom.operators.statements import text_to_lines
from ledgerloom.plans.ordered import first_per_key, number_rows
from ledgerloom.sources import schemas


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Headered text files; files that are not valid UTF-8 are read as Latin-1.

    The encoding check runs on the executors, file by file; only the two path lists, one
    entry per file, come back.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    verdicts = files.collect()
    by_kind = {"UTF-8": [r["path"] for r in verdicts if r["utf8"]], "ISO-8859-1": [r["path"] for r in verdicts if not r["utf8"]]}
    parts = [
        spark.read.csv(paths, header=True, sep=sep, encoding=enc, multiLine=True, quote='"', escape='"')
        for enc, paths in by_kind.items()
        if paths
    ]
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, pos, text) of whole text files; the file path is the document id."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return text_to_lines(docs)


def read_pasted_worksheet(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", order: str = "pos") -> DataFrame:
    """Pasted worksheet lines to typed rows; the first row of each paste decides its layout.

    Seven to ten columns; with two dates the later one counts; a lone dash is zero.
    """
    cells = lambda line: F.split(F.trim(line), r"\s+")
    lines = rows.filter(blank(text) != "")
    head = lines.groupBy(*keys).agg(F.min_by(text, order).alias("h")).withColumn("h", cells("h"))
    n_dates = F.size(F.filter("h", lambda v: date_parse(v).isNotNull()))
    head = head.select(*keys, F.size("h").alias("n"), n_dates.alias("d"))
    # Lines are split once, after the join, and each cell is read once.
    r = lines.join(head, list(keys)).withColumn("c", cells(text))
    two = (F.col("n") == 10) | ((F.col("n") == 8) & (F.col("d") == 2))
    has_sum = (F.col("n") >= 9) | ((F.col("n") == 8) & (F.col("d") == 1))
    has_pi = F.col("n") >= 9
    valid = F.col("n").isin(7, 9, 10) | ((F.col("n") == 8) & F.col("d").isin(1, 2))
    shift = F.when(two, 1).otherwise(0)
    cell = lambda i: F.try_element_at("c", (F.lit(i) + shift).cast("int"))
    after = lambda k: F.when(has_sum, cell(k + 1)).otherwise(cell(k))
    dates = {"__first": date_parse(F.try_element_at("c", F.lit(1))), "__second": F.when(two, date_parse(F.try_element_at("c", F.lit(2))))}
    return r.filter(valid).withColumns(dates).select(
        *keys, F.col(order).alias("row_no"),
        F.greatest("__first", "__second").alias("date"),
        worksheet_money(cell(2)).alias("total"), worksheet_money(cell(3)).alias("ui"), worksheet_money(cell(4)).alias("ett"),
        F.when(has_sum, worksheet_money(cell(5))).cast(MONEY).alias("ui_ett"),
        worksheet_money(after(5)).alias("sdi"), worksheet_money(after(6)).alias("pit"),
        F.when(has_pi, worksheet_money(cell(8))).cast(MONEY).alias("p_i"),
        worksheet_money(F.when(has_pi, cell(9)).otherwise(after(7))).alias("edd_total"),
    )


def clean_person(r: Column, default_role: str = "officer") -> Column:
    """A relation with every field present, its name composed, and one link id."""
    name, first = blank(r["name"]), blank(r["first_name"])
    parts = [blank(r[c]) for c in ("middle_name", "last_name", "nickname")]
    alone = (first == "") & (parts[0] == "") & (parts[1] == "") & (parts[2] == "")
    first = F.when(alone, name).otherwise(first)
    composed = person_name(first, *parts)
    link = F.coalesce(present(r["id"]), present(r["other_id"]), present(r["linked_client_id"]), F.lit(""))
    role = F.lower(blank(r["role"]))
    plain = ("email", "phone", "addr1", "addr2", "city", "state", "zip", "dob")
    return F.struct(
        link.alias("id"), F.coalesce(F.nullif(composed, F.lit("")), name).alias("name"), first.alias("first_name"),
        parts[0].alias("middle_name"), parts[1].alias("last_name"), parts[2].alias("nickname"),
        *[blank(r[c]).alias(c) for c in plain],
        F.when((role == "") & (link == ""), default_role).otherwise(role).alias("role"),
        link.alias("linked_client_id"), F.coalesce(present(r["other_label"]), blank(r["linked_client_label"])).alias("linked_client_label"),
    )


def normalize_clients(raw: DataFrame) -> DataFrame:
    """Defaults for every field; legacy owner and officers folded into relations; logs cleaned."""
    person = f"array<{schemas.PERSON}>"
    empty = lambda t: F.array().cast(t)
    names = ("id", "name", "first_name", "middle_name", "last_name", "nickname", "email", "phone", "addr1", "addr2", "city",
             "state", "zip", "dob", "role", "linked_client_id", "linked_client_label", "other_id", "other_label")
    owner = F.array(F.struct(*[(F.trim("owner") if n == "name" else F.lit(None).cast("string")).alias(n) for n in names]))
    legacy = F.when(F.col("relations").isNull() & (blank("owner") != ""), owner)
    people = F.concat(F.coalesce("relations", legacy, empty(person)), F.coalesce("officers", empty(person)))
    cols = {c: F.coalesce(F.col(c), F.lit("")) for c in schemas.CLIENT_TEXT}
    cols["id"] = blank("id")
    cols["relations"] = F.transform(people, lambda r: clean_person(r))
    cols["employees"] = F.transform(F.coalesce("employees", empty(person)), lambda r: clean_person(r))
    cols["logs"] = F.transform(
        F.coalesce("logs", empty(f"array<{schemas.LOG}>")),
        lambda x: F.struct(
            blank(x["ts"]).alias("ts"), blank(x["user"]).alias("user"), blank(x["text"]).alias("text"),
            F.coalesce(x["done"], F.lit(False)).alias("done"), F.coalesce(x["edited"], F.lit(False)).alias("edited"),
            F.lower(F.coalesce(present(x["log_type"]), F.lit("memo"))).alias("log_type"),
        ),
    )
    for c, t in schemas.CLIENT_LISTS.items():
        if c not in ("relations", "officers", "employees", "logs"):
            cols[c] = F.coalesce(F.col(c), empty(f"array<{t}>"))
    return raw.withColumns(cols).drop("owner", "officers")


def with_position(raw: DataFrame, name: str) -> DataFrame:
    """Add the row's position, from 0, in path order and then file order; `raw` is a file scan."""
    seated = raw.select("*", F.lit(0).alias("__g"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__seq"))
    placed = number_rows(seated, ["__g"], ["__file", "__at", "__seq"], [F.col("__file"), F.col("__at")], name)
    return placed.withColumn(name, F.col(name) - 1).drop("__g", "__file", "__at", "__seq")


def read_clients(spark: SparkSession, path: str) -> DataFrame:
    """Client book, a JSON list per file; client_idx is the position over all files in path order."""
    raw = spark.read.schema(schemas.CLIENTS).json(path, multiLine=True)
    return normalize_clients(with_position(raw, "client_idx"))


def type_tasks(raw: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Typed tasks: kind upper-cased, recurrence flattened, dates parsed, client position by name."""
    out = raw
    for old in ("company_idx", "company_name", "company_id"):
        new = old.replace("company", "client")
        out = out.withColumn(new, F.coalesce(new, old)).drop(old)
    day = lambda c: present(c).try_cast("date")
    bag = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda d: F.trim(d).try_cast("date")), lambda d: d.isNotNull())
    out = out.select(
        "id", F.upper(F.coalesce("kind", F.lit("OTHER"))).alias("kind"), blank("kind_other").alias("kind_other"), blank("title").alias("title"),
        "client_idx", blank("client_name").alias("client_name"), blank("client_id").alias("client_id"), blank("ein").alias("ein"),
        F.coalesce("recurrence.freq", F.lit("one-off")).alias("freq"), "recurrence.dom", "recurrence.dom2", "recurrence.weekday",
        date_parse("recurrence.anchor_date").alias("anchor_date"), "recurrence.months",
        *[day(c).alias(c) for c in ("start_on", "effective_from", "end_on", "pause_from", "resume_from")],
        F.coalesce("is_paused", F.lit(False)).alias("is_paused"), F.coalesce("is_enabled", F.lit(True)).alias("is_enabled"),
        date_parse("due").alias("due"), F.coalesce("action_lead_days", F.lit(0)).alias("action_lead_days"),
        blank("method").alias("method"), bag("completed").alias("completed"), bag("cancelled").alias("cancelled"),
    )
    if clients is None:
        return out
    named = clients.select(F.trim("name").alias("client_name"), F.col("client_idx").alias("__i")).filter(F.col("client_name") != "")
    named = named.groupBy("client_name").agg(F.min("__i").alias("__i"))
    return out.join(named, "client_name", "left").withColumn("client_idx", F.coalesce("client_idx", "__i")).select(*out.columns)


def read_tasks(spark: SparkSession, path: str, clients: DataFrame | None = None) -> DataFrame:
    return type_tasks(spark.read.schema(schemas.TASKS).json(path, multiLine=True), clients)


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """Nested section, year, company, cell maps to long rows with plain states."""
    cell = "map<string,map<string,string>>"
    year = f"map<string,struct<companies:array<string>,cells:{cell}>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<years:{year}>>").alias("m"))
    sections = raw.select(F.explode("m").alias("section", "s")).select("section", F.explode("s.years").alias("year", "y"))
    rows = sections.select("section", F.col("year").try_cast("int").alias("year"), F.explode("y.companies").alias("company_key"), "y.cells")
    names = F.array(*[F.lit(c) for c in ("Jan", "Feb", "Mar", "Q1", "Apr", "May", "Jun", "Q2", "Jul", "Aug", "Sep", "Q3", "Oct", "Nov", "Dec", "Q4")])
    long = rows.select("section", "year", "company_key", F.explode(names).alias("col"), F.try_element_at("cells", F.col("company_key")).alias("row"))
    return long.select("section", "year", "company_key", "col", normalize_cell(F.try_element_at("row", F.col("col"))).alias("value"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(company file, rule_no, phrase, vendor); rows need both fields."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.posexplode(F.from_json("value", "array<struct<phrase:string,vendor:string>>")).alias("rule_no", "r")
    )
    return raw.select("source", "rule_no", blank("r.phrase").alias("phrase"), blank("r.vendor").alias("vendor")).filter(
        (F.col("phrase") != "") & (F.col("vendor") != "")
    )


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(source, vendor, direction, account); keys split on the last bar, bare keys mean both directions."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")
    )
    key = F.trim("k")
    tail = F.trim(F.substring_index(key, "|", -1))
    split = key.contains("|") & tail.isin("debits", "credits")
    vendor = F.when(split, F.trim(F.substr(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, "|", -1)) - 1))).otherwise(key)
    both = F.array(F.lit("debits"), F.lit("credits"))
    rows = raw.filter(key != "").select(
        "source", vendor.alias("vendor"), F.explode(F.when(split, F.array(tail)).otherwise(both)).alias("direction"),
        F.trim("v").alias("account"), split.alias("__own"),
    )
    return first_per_key(rows, ["source", "vendor", "direction"], [~F.col("__own")]).drop("__own")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed company names, sorted; a list or an object with a companies list."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "struct<companies:array<string>>")["companies"], F.from_json("value", "array<string>"))
    names = raw.select(F.explode(listed).alias("company")).select(F.trim("company").alias("company"))
    return names.filter(F.col("company") != "").distinct().orderBy("company")


def read_managers(spark: SparkSession, path: str) -> DataFrame:
    """Account managers from names or objects, deduped, with stable ids."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "x"))
    obj = F.from_json("x", "struct<id:string,name:string,email:string,phone:string>")
    is_obj = F.trim("x").startswith("{")
    rows = raw.select(
        "pos", F.when(is_obj, obj["id"]).alias("id"), F.when(is_obj, obj["name"]).otherwise(F.col("x")).alias("name"),
        F.when(is_obj, obj["email"]).alias("email"), F.when(is_obj, obj["phone"]).alias("phone"),
    )
    return dedupe_managers(rows.filter(is_obj | (blank("name") != "")))


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """Vendor sheet rows with their order, ready for the dictionary."""
    return read_delimited(spark, path).withColumn("row_no", F.monotonically_increasing_id())

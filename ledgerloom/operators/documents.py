"""Document register: classes, latest and as-of lookups, unique names, new index numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank, present
from ledgerloom.plans.ordered import Scan, block_of, first_per_key, number_rows, scan
from ledgerloom.plans.session import cut_lineage

# Document types by cluster for each entity form; LLC is the default form.
_TAX = ("EIN Confirmation Letter", "EFTPS Enrollments", "EFTPS PIN Letter", "EDD Registration")
_PERMIT = ("Seller's Permit", "Board of Equalization Registration")
_CORPORATE = (
    "Articles of Incorporation", "Statement of Information", "Stock Certificate",
    "Corporate Bylaws", "Shareholder/Board Minutes", "Fictitious Business Name Statement",
)
_COMPANY = (
    "Articles of Organization", "Operating Agreement", "Statement of Information",
    "Member Certificate", "Fictitious Business Name Statement",
)
CLUSTERS = {
    "S-Corporation": {"Corporate / Entity": _CORPORATE},
    "Corporation (C-Corp)": {"Corporate / Entity": _CORPORATE},
    "LLC": {"Corporate / Entity": _COMPANY},
    "Individual / Sole Proprietor": {"Business / Entity": ("Business License", "Fictitious Business Name Statement")},
}
SHARED_CLUSTERS = {"Taxes (Federal/State Payroll & EFTPS)": _TAX, "Sales Tax / Permits (CDTFA/BOE)": _PERMIT}
BUCKETS = ("EFTPS", "EDD", "IRS/EIN", "Other Taxes", "Non-Tax")
QUARTERS = {"1Q": 1, "2Q": 2, "3Q": 3, "4Q": 4}
ALLOWED_FILES = r"(?i)\.(pdf|jpg|jpeg|png)$"


def cluster_of(entity: Column, doc_type: Column) -> Column:
    """Cluster of a type under its entity form; Other when listed nowhere."""
    shared = F.lit("Other")
    for name, types in SHARED_CLUSTERS.items():
        shared = F.when(doc_type.isin(*types), name).otherwise(shared)

    def own(form: str) -> Column:
        out = shared
        for name, types in CLUSTERS[form].items():
            out = F.when(doc_type.isin(*types), name).otherwise(out)
        return out

    verdict = own("LLC")
    for form in CLUSTERS:
        verdict = F.when(F.trim(entity) == form, own(form)).otherwise(verdict)
    return verdict


def classify_document_type(docs: DataFrame, doc_type: str = "type", entity: str | Column = "entity_type") -> DataFrame:
    """Add cluster, category, subcluster and tags; the tax family goes by words in the type."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    t = F.lower(blank(doc_type))
    sub = F.when(t.contains("eftps"), "EFTPS").when(t.contains("edd"), "EDD").when(t.contains("ein") | t.contains("irs"), "IRS/EIN")
    cluster = cluster_of(entity, F.col(doc_type))
    return docs.withColumns(
        {
            "cluster": cluster,
            "category": F.when(sub.isNotNull(), "Taxes").otherwise(cluster),
            "subcluster": F.coalesce(sub, F.lit("")),
            "tags": F.when(sub.isNotNull(), F.array(F.lit("Taxes"), sub)).otherwise(F.array(cluster)),
        }
    )


def group_document_types(types: DataFrame, docs: DataFrame | None = None, hide_empty: bool = False) -> DataFrame:
    """(bucket, bucket_no, type): tax buckets in fixed order; hide_empty keeps types that have a document."""
    out = classify_document_type(types, "type", F.lit("LLC"))
    bucket = F.when(F.col("subcluster") != "", F.col("subcluster")).otherwise("Non-Tax")
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket)
    out = out.select(bucket.alias("bucket"), place.alias("bucket_no"), "type")
    return out.join(docs.select("type").distinct(), "type", "left_semi") if hide_empty else out


def _quarter(c: Column) -> Column:
    out = F.lit(0)
    for name, n in QUARTERS.items():
        out = F.when(F.upper(c) == name, n).otherwise(out)
    return out


def recency() -> Column:
    """(year, quarter, month, ts) as a comparable struct."""
    return F.struct(
        F.coalesce(F.col("year"), F.lit(0)).alias("y"), _quarter(blank("quarter")).alias("q"),
        F.coalesce(F.col("month"), F.lit(0)).alias("m"), F.coalesce(F.col("ts"), F.lit("1970-01-01 00:00")).alias("t"),
    )


def latest_document(docs: DataFrame, keys: Sequence[str] = ("client_idx", "type"), year: int | None = None, quarter: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Most recent document per key, optionally of one year and quarter. An aggregation, no sort."""
    if year is not None:
        docs = docs.filter(F.col("year") == year)
    if quarter:
        docs = docs.filter(blank("quarter") == quarter)
    ranked = docs.withColumn("__rec", recency())
    order = [F.col("__rec"), *[F.col(c) for c in tie]]
    return first_per_key(ranked, list(keys), order, last=True).drop("__rec")


def latest_document_asof(docs: DataFrame, wanted: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """For each (client_idx, type, as_of_year, as_of_quarter) the latest document not after it.

    A blank quarter means the year's end.  Documents and questions merge into one ordered
    timeline per (client, type) and the last document is carried to each question: an as-of
    join without a range join, on chunked groups.
    """
    key = ["client_idx", "type"]
    asof_q = _quarter(blank("as_of_quarter"))
    q = wanted.select(
        *key, "as_of_year", "as_of_quarter", F.col("as_of_year").alias("__y"), F.when(asof_q == 0, 4).otherwise(asof_q).alias("__q"),
        F.lit(1).alias("__side"),
    )
    names = [c for c in docs.columns if c not in key]
    d = docs.select(
        *key, F.coalesce("year", F.lit(0)).alias("__y"), _quarter(blank("quarter")).alias("__q"), F.lit(0).alias("__side"),
        recency().alias("__rec"), F.struct(*names).alias("__doc"), F.struct(*(tie or names[:1])).alias("__tie"),
    )
    # Only the latest document of each (year, quarter) can be an answer.
    best = d.groupBy(*key, "__y", "__q", "__side").agg(F.max_by("__doc", F.struct("__rec", "__tie")).alias("__doc"))
    both = best.unionByName(q.distinct(), allowMissingColumns=True)
    both = both.withColumn("__n", F.coalesce(F.concat_ws("|", F.col("as_of_year").cast("string"), F.coalesce("as_of_quarter", F.lit(""))), F.lit("")))
    found = scan(both, key, ["__y", "__q", "__side", "__n"], [F.col("__y")], {"hit": Scan("last", F.col("__doc"))})
    return found.filter("__side = 1").select(*key, "as_of_year", "as_of_quarter", F.col("hit.*"))


def register_documents(register: DataFrame, uploads: DataFrame, now: str) -> DataFrame:
    """New register rows numbered after the highest index of their (client, year, quarter, type).

    Index 1 has no suffix: `2024_1Q_Insurance.pdf`, then `2024_1Q_Insurance_2.pdf`.
    """
    key = ["client_idx", "year", "quarter", "type"]
    q = F.upper(blank("quarter"))
    up = uploads.filter(F.col("path").rlike(ALLOWED_FILES)).withColumn("quarter", F.when(q.isin(*QUARTERS), q).otherwise(""))
    up = up.withColumn("type", F.coalesce(present("type"), F.lit("Misc")))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    used = register.withColumn("quarter", blank("quarter")).groupBy(*key).agg(
        F.max(F.coalesce(F.regexp_extract(stem, r"_(\d+)$", 1).try_cast("int"), F.lit(1))).alias("__max")
    )
    ranked = number_rows(up, key, ["pos"], [block_of("pos")], "__rn").join(used, key, "left")
    index = F.coalesce("__max", F.lit(0)) + F.col("__rn")
    qtag = F.when(F.col("quarter") == "", "").otherwise(F.concat(F.lit("_"), F.col("quarter")))
    ext = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    suffix = F.when(index == 1, "").otherwise(F.concat(F.lit("_"), index.cast("string")))
    name = F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), qtag, F.lit("_"), F.col("type"), suffix, ext)
    made = ranked.withColumn("index", index.cast("bigint")).withColumn("name", name).withColumn("ts", F.lit(now))
    entity = "entity_type" if "entity_type" in uploads.columns else F.lit("LLC")
    return classify_document_type(made, "type", entity).drop("__rn", "__max")


def unique_names(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Add `unique_name`: files in order take `name`, `name (1)`, ... skipping names in use.

    files: folder, name, ord (unique per folder); existing: folder, name.  Comparison ignores
    case.  A family of equal names is numbered in one step; only when two families claim the
    same text does the folder repeat from the earlier loser on.
    """
    low = lambda c: F.lower(c)
    ext = F.regexp_extract("name", r"(?<=[^.])(\.[^.]*)$", 1)
    base = F.substr("name", F.lit(1), F.length("name") - F.length(ext))
    todo = files.select("folder", "name", "ord", base.alias("base"), ext.alias("ext"), low(F.col("name")).alias("fam"))
    taken = existing.select("folder", low(F.col("name")).alias("low")).distinct()
    done = None
    while True:
        placed = _place(todo, taken)
        claimed = placed.groupBy("folder", low(F.col("unique_name")).alias("low")).agg(F.min("ord").alias("__owner"), F.count("*").alias("__n"))
        clash = placed.withColumn("low", low(F.col("unique_name"))).join(claimed.filter("__n > 1"), ["folder", "low"])
        redo = clash.filter(F.col("ord") > F.col("__owner")).groupBy("folder").agg(F.min("ord").alias("__redo"))
        redo = cut_lineage(redo)
        if redo.isEmpty():
            return placed if done is None else done.unionByName(placed)
        split = cut_lineage(placed.join(redo, "folder", "left"))
        final = split.filter(F.col("__redo").isNull() | (F.col("ord") < F.col("__redo"))).select("folder", "name", "ord", "unique_name")
        done = final if done is None else cut_lineage(done.unionByName(final))
        again = split.filter(F.col("ord") >= F.col("__redo")).select("folder", "ord")
        todo = cut_lineage(todo.join(again, ["folder", "ord"], "left_semi"))
        taken = cut_lineage(taken.unionByName(final.select("folder", low(F.col("unique_name")).alias("low"))).distinct())


def _place(todo: DataFrame, taken: DataFrame) -> DataFrame:
    """Give the k-th waiting file of a family its k-th free number."""
    numbered = r"^(.*) \(([1-9][0-9]*)\)(\.[^.]*)?$"
    own = taken.select("folder", F.col("low").alias("fam"), F.lit(0).alias("idx"))
    other = taken.filter(F.col("low").rlike(numbered)).select(
        "folder",
        F.concat(F.regexp_extract("low", numbered, 1), F.regexp_extract("low", numbered, 3)).alias("fam"),
        F.regexp_extract("low", numbered, 2).try_cast("int").alias("idx"),
    )
    used = own.unionByName(other).join(todo.select("folder", "fam").distinct(), ["folder", "fam"], "left_semi")
    used = number_rows(used, ["folder", "fam"], ["idx"], [block_of("idx")], "__k")
    # Free numbers below the k-th used one: idx - (k - 1).
    marks = used.select("folder", "fam", (F.col("idx") - F.col("__k") + 1).cast("bigint").alias("at"), F.lit(0).alias("side"), F.col("idx").cast("bigint").alias("tie"))
    ranked = number_rows(todo, ["folder", "fam"], ["ord"], [block_of("ord")], "__r")
    asks = ranked.select("folder", "fam", (F.col("__r") - 1).alias("at"), F.lit(1).alias("side"), F.col("ord").cast("bigint").alias("tie"), "name", "ord", "base", "ext")
    both = marks.unionByName(asks, allowMissingColumns=True)
    seen = scan(both, ["folder", "fam"], ["at", "side", "tie"], [block_of("at")], {"skip": Scan("sum", F.when(F.col("side") == 0, 1).otherwise(0))})
    n = F.col("at") + F.col("skip")
    shown = F.when(n == 0, F.col("name")).otherwise(F.concat("base", F.lit(" ("), n.cast("string"), F.lit(")"), F.col("ext")))
    return seen.filter("side = 1").select("folder", "name", "ord", shown.alias("unique_name"))

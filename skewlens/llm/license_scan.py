"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies; DataFrame functions only.

Words are runs of ASCII letters and digits, in lower case; a shingle is five words.  Templates are grouped by size: a
template of at most p shingles (p a power of two) is sought in windows of 2p shingles that start at every multiple of
p, so each passage of its size lies whole in one window.  A band is one MinHash value of the window, equal to the template's.
A window that holds the template has a resemblance of 1/4 at least and meets it in one of 48 bands with probability 1 - 10^-6;
one that holds 0.8 of it, of 0.18 at least, with 0.9999.  A band can only be equal where the window holds the shingle that
is the template's minimum (an anchor), so MinHash values are computed for windows around anchors only; that loses none.
Candidates are verified by exact containment: at least 0.8 of the template's shingles are in the window.

Defined results: null counts as empty; a text or template of one to four words has one shingle, all its words; a text without
such words matches nothing; rows that repeat id and text repeat the result; of windows with equal containment the first counts;
templates without words are ignored; near-identical notices (a text and its next version) may both be found, each with its
containment; an empty table gives an empty result.  The templates are a parameter; the list of the query is in ``license_texts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm.common import cut, text_of
from skewlens.llm.license_texts import templates

BANDS = 48
#: About 400 notices and texts in common use.
TEMPLATES = templates()
#: Anchors that are looked up as a literal of the plan; more of them are joined.
MOST_LISTED = 50_000
#: Bytes of the templates' bands that may be broadcast, and of one of them.
BROADCAST_BYTES, BAND_BYTES = 16 << 20, 64


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 4))
    # The words are bound once by a transform over a one-element array, so they are not found again for each shingle.
    every = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))))
    return F.coalesce(F.element_at(every, 1), F.array().cast("array<bigint>"))


def _minima(window: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda j: F.array_min(F.transform(window, lambda x: F.xxhash64(x, j))))


def _template_table(spark: SparkSession, templates: dict[str, str], bands: int) -> DataFrame:
    """(template, p, wanted: distinct shingles, minima); a few rows, whatever the corpus."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string")
    sets = rows.select("template", F.array_distinct(shingles(F.col("body"))).alias("wanted")).where(F.size("wanted") > 0)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("wanted").cast("double")))).cast("int")
    return sets.select("template", size.alias("p"), "wanted", _minima(F.col("wanted"), bands).alias("minima"))


def _anchors(templates: DataFrame) -> DataFrame:
    """(p, shingle): the template shingles with the least hash in some band."""
    each = templates.select("p", F.explode("wanted").alias("shingle"), "minima")
    hit = F.exists(F.sequence(F.lit(0), F.size("minima") - 1), lambda j: F.xxhash64("shingle", j) == F.element_at("minima", j + 1))
    return each.where(hit).select("p", "shingle").distinct()


def _anchored(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows whose shingles hold an anchor.  Their number does not grow with the documents; it is measured nevertheless."""
    if anchors.count() <= MOST_LISTED:
        listed = F.array(*[F.lit(int(r[0])) for r in anchors.collect()]).cast("array<bigint>")
        return rows.where(F.arrays_overlap("h", listed))
    hits = rows.select("__li_id", "__li_key", F.explode("h").alias("shingle")).join(anchors, "shingle", "left_semi").select(
        F.col("__li_id").alias("i"), F.col("__li_key").alias("k"))
    return rows.join(hits, F.col("__li_id").eqNullSafe(F.col("i")) & (F.col("__li_key") == F.col("k")), "left_semi")


def find(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(__li_id, __li_key, template, containment, shingle): each template found in a document, in its best window."""
    spark = docs.sparkSession
    known = cut(_template_table(spark, TEMPLATES if templates is None else templates, bands), "templates")
    anchors = cut(_anchors(known), "anchors")
    rows = docs.select(F.col(id_col).alias("__li_id"), F.xxhash64(text_of(text_col)).alias("__li_key"), shingles(text_of(text_col)).alias("h"))
    some = cut(_anchored(rows, anchors.select("shingle").distinct()).dropDuplicates(["__li_id", "__li_key"]), "anchored")
    at = some.select("__li_id", "__li_key", F.posexplode("h").alias("pos", "shingle")).join(anchors, "shingle")
    first = F.expr("pos div p")
    windows = at.select("__li_id", "__li_key", "p", F.explode(F.array(first - 1, first)).alias("w")).where("w >= 0").distinct()
    rows_of = some.select(F.col("__li_id").alias("i"), F.col("__li_key").alias("k"), "h")
    windows = windows.join(rows_of, F.col("__li_id").eqNullSafe(F.col("i")) & (F.col("__li_key") == F.col("k"))).select(
        "__li_id", "__li_key", "p", "w", F.expr("array_distinct(slice(h, cast(w * p + 1 as int), 2 * p))").alias("window"))
    windows = cut(windows, "windows")
    bands_of = windows.select("__li_id", "__li_key", "p", "w", F.posexplode(_minima(F.col("window"), bands)).alias("band", "least"))
    template_bands = known.select("template", "p", F.posexplode("minima").alias("band", "least"))
    # A row per template and band, however many documents there are.  Many windows share a minimum, so theirs do not shuffle by it.
    if known.count() * bands * BAND_BYTES <= BROADCAST_BYTES:
        template_bands = F.broadcast(template_bands)
    met = bands_of.join(template_bands, ["p", "band", "least"]).select("__li_id", "__li_key", "p", "w", "template").distinct()
    whole = windows.toDF("i", "k", "q", "v", "window")
    held = met.join(whole, F.col("__li_id").eqNullSafe(F.col("i")) & (F.col("__li_key") == F.col("k"))
                    & (F.col("p") == F.col("q")) & (F.col("w") == F.col("v")))
    held = held.select("__li_id", "__li_key", "p", "w", "template", "window")
    scored = held.join(known.select("template", "wanted"), "template").select(
        "__li_id", "__li_key", "template", (F.col("w") * F.col("p")).alias("shingle"),
        (F.size(F.array_intersect("window", "wanted")) / F.size("wanted")).alias("containment"))
    return (scored.where(F.col("containment") >= least).groupBy("__li_id", "__li_key", "template")
                  .agg(F.max_by(F.struct("containment", "shingle"), F.struct("containment", -F.col("shingle"))).alias("b"))
                  .select("__li_id", "__li_key", "template", "b.*"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """One row per document: the id and ``licenses``, an array of (template, containment, shingle) by template."""
    found = cut(find(docs, templates, id_col, text_col, least, bands).groupBy("__li_id", "__li_key").agg(
        F.array_sort(F.collect_list(F.struct("template", "containment", "shingle"))).alias("licenses")), "found")
    found = found.select(F.col("__li_id").alias("i"), F.col("__li_key").alias("k"), "licenses")
    rows = docs.select(F.col(id_col).alias("__li_id"), F.xxhash64(text_of(text_col)).alias("__li_key"))
    out = rows.join(found, F.col("__li_id").eqNullSafe(F.col("i")) & (F.col("__li_key") == F.col("k")), "left")
    nothing = F.array().cast(dict(found.dtypes)["licenses"])
    return out.select(F.col("__li_id").alias(id_col), F.coalesce("licenses", nothing).alias("licenses"))

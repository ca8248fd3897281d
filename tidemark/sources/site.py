"""Site tables derived from the shared test tables; each rule is deterministic and has the same meaning in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a scan below which its rows are dealt anew; the rows are the same either way.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small scan's rows over all cores: a file of one row group is one task otherwise. Larger scans stay as they are."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)


def search_docs(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """documents as search documents of type file."""
    d, i = stream(spark, sf_dir, "documents") if streaming else spread(read(spark, sf_dir, "documents")), F.col("doc_id")
    protected = F.when(i % 11 == 0, F.lit(None)).otherwise(i % 7 == 0)
    return d.select(
        F.concat(F.lit("file-"), i).alias("id"), F.lit("file").alias("type"), F.col("lang").alias("locale"),
        F.concat(F.lit("Document "), i).alias("title"), F.concat(F.lit("/files/"), "source", F.lit("/"), "lang", F.lit("/"), i, F.lit(".txt")).alias("url"),
        F.col("text").alias("content"), F.array("source", F.lit("txt")).alias("tags"), F.lit(None).cast("long").alias("published_at"), F.lit(1.0).alias("weight"),
        protected.alias("is_protected"), F.when(protected, F.array((i % 5 + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("allowed_groups"),
        (F.lit(1_700_000_000) + i).alias("indexed_at"), i.alias("doc_id"),
    )


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as roots, folders and leaves."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    cols = lambda i, p, title, lang, kind, protected, group, suffix: [i.cast("long").alias("id"), p.cast("long").alias("pid"), title.alias("title"), lang.alias("language"), F.lit(kind).alias("type"), protected.alias("protected"), group.cast("int").alias("grp"), suffix.alias("url_suffix")]
    none = F.lit(None).cast("string")
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "es", "xx"))), F.col("r_regionkey").cast("int") + 1)
    roots = r.select(*cols(F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), lang, "root", F.lit(False), F.lit(0), F.when(F.col("r_regionkey") % 2 == 0, ".htm")))
    folders = n.select(*cols(F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 0, "en"), "regular", F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 5 + 1, none))
    leaves = c.select(*cols(F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, F.col("c_name"), none, "regular", F.col("c_custkey") % 10 == 0, F.col("c_custkey") % 7 + 1, none))
    return roots.unionByName(folders).unionByName(leaves)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a file registry, with repeated paths."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    folder = F.element_at(F.split("o_orderpriority", "-"), 1)
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "docs"))), (k % 4).cast("int") + 1)
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "txt", "MD", "docx", "odt", "exe"))), (k % 6).cast("int") + 1)
    suffix = F.when(k % 5 == 0, "_de").when(k % 5 == 1, "-en").otherwise("")
    return o.select(k.alias("id"), F.concat(F.lit("files/"), lang, F.lit("/"), folder, F.lit("/item"), F.floor(k / 2).cast("long"), suffix, F.lit("."), ext).alias("path"), F.col("o_custkey").alias("page"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("tag_id"), F.concat_ws(" ", "p_brand", "p_type", "p_partkey").alias("label"))


def tag_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tag_id"), F.col("l_orderkey").alias("target_id")).dropDuplicates()


def search_events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    e = (stream if streaming else read)(spark, sf_dir, "events")
    locale = F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "es"))), (F.col("user_id") % 4).cast("int") + 1)
    return e.select(F.col("event_type").alias("q"), locale.alias("locale"), F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("results"), F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp").alias("ts") if streaming else "ts")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page tree with what makes a page indexable and how it is shown."""
    i = F.col("id")
    return page_tree(spark, sf_dir).select(
        "id", "pid", "title", "language", "type", F.when(F.col("protected"), "1").otherwise("").alias("protected"), "grp", F.col("url_suffix").alias("urlSuffix"),
        F.when(i % 50 == 0, "index").otherwise(F.concat(F.lit("p"), i)).alias("alias"), F.when(i % 17 == 0, "").otherwise("1").alias("published"), F.when(i % 13 == 0, "noindex,follow").otherwise("index").alias("robots"),
        F.when(i % 19 == 0, "1").otherwise("").alias("noSearch"), F.concat(F.lit("k"), i % 5, F.lit(", k"), i % 3).alias("keywords"), F.when(i % 2 == 0, F.concat(F.lit("About "), "title")).alias("description"),
        F.when(i % 4 == 0, F.concat(F.lit("Page "), i)).alias("pageTitle"), (F.lit(1_600_000_000) + i).alias("tstamp"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as articles of their customers' pages."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") + 1000).alias("pid"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("teaser"),
        F.when(k % 9 == 0, "left").otherwise("main").alias("inColumn"), F.when(k % 8 == 0, "").otherwise("1").alias("published"),
    )


def picture(number) -> Column:
    """The uuid of the file that a number stands for."""
    return F.unhex(F.md5(F.concat(F.lit("picture"), number)))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as content elements: some headlines are serialised, some show a file, some a list of two."""
    n, p, text = F.col("l_linenumber"), F.col("l_partkey"), lambda s: F.lit(s).cast("binary")
    headline = F.when(n % 3 == 0, F.concat(F.lit('a:2:{s:5:"value";s:6:"Line '), n, F.lit('";s:4:"unit";s:2:"h2";}'))).when(n % 3 == 1, F.concat(F.lit("<i>"), "l_returnflag", F.lit("</i>")))
    several = F.concat(text('a:2:{i:0;s:16:"'), picture(p), text('";i:1;s:16:"'), picture(p + 1), text('";}'))
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("pid"), headline.alias("headline"), F.concat(F.lit("<p>"), "l_linestatus", F.lit(" "), "l_partkey", F.lit("</p>")).alias("text"),
        F.when(F.col("l_suppkey") % 6 == 0, "1").otherwise("").alias("invisible"), n.cast("long").alias("sorting"), F.when(p % 10 == 0, picture(p)).alias("singleSRC"), F.when(p % 10 == 1, several).alias("multiSRC"),
    )


def slugged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_id, slug, label of the parts, a slug for each."""
    return tags(spark, sf_dir).select("tag_id", F.concat(F.lit("part-"), "tag_id").alias("slug"), "label")


def typed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_id, target_type, target_id: to pages for odd orders, to files for even ones."""
    a = tag_assignments(spark, sf_dir)
    return a.select("tag_id", F.when(F.col("target_id") % 2 == 1, "page").otherwise("file").alias("target_type"), F.col("target_id").cast("string").alias("target_id"))

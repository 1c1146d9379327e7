"""Which source of a catalog a book or page belongs to, by what is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import urls as U

from .shelf import LOCAL, is_local

#: Rows of a catalog up to which it is broadcast.
FEW = 100_000


def _suffixes(rows: DataFrame, host: str, out: str) -> DataFrame:
    """rows with every end of a host, letter by letter."""
    return rows.withColumn(out, F.explode(F.transform(F.sequence(F.lit(1), F.length(host)), lambda i: F.substring(F.col(host), i, F.length(F.col(host))))))


def sources_of_hosts(hosts: DataFrame, catalog: DataFrame) -> DataFrame:
    """host and source_ord: the first source in the catalog's order whose host ends with the host or the other way round, or
    has the same label before the last. Ends meet by equality: a catalog of any size, hosts of any number of labels."""
    known = catalog.select("source_ord", U.host(U.normalise(F.col("source_url"))).alias("own")).where("own <> ''")
    firsts = known.groupBy("own").agg(F.min("source_ord").alias("source_ord"))
    each = hosts.where("host <> ''").select("host").distinct()
    ends = _suffixes(each, "host", "own").join(firsts, "own").select("host", "source_ord")
    begins = _suffixes(firsts, "own", "host").select("host", "source_ord").groupBy("host").agg(F.min("source_ord").alias("source_ord")).join(each, "host").select("host", "source_ord")
    label = firsts.groupBy(U.root_label(F.col("own")).alias("label")).agg(F.min("source_ord").alias("source_ord")).where("label <> ''")
    same = each.withColumn("label", U.root_label(F.col("host"))).join(label, "label").select("host", "source_ord")
    return ends.unionByName(begins).unionByName(same).groupBy("host").agg(F.min("source_ord").alias("source_ord"))


def resolve_sources(books: DataFrame, catalog: DataFrame, shelf: DataFrame | None = None) -> DataFrame:
    """books (book_url, given and more) with source_ord, source_url and how: 'local' books by their scheme or origin; by
    the source URL that is given, 'given', or nothing if no source has it; by the 'shelf' origin of the book's URL;
    by its 'host'. catalog: source_url, source_ord. URLs compare without control characters and blanks around them; of equal
    ones the first in the catalog's order counts, of shelf rows of one URL the least origin."""
    by_url = catalog.select(U.normalise(F.col("source_url")).alias("_url"), "source_ord").where("_url <> ''").groupBy("_url").agg(F.min("source_ord").alias("_ord"))
    by_url = F.broadcast(by_url) if by_url.limit(FEW + 1).count() <= FEW else by_url
    rows = books.withColumn("_given", F.nullif(U.normalise(F.col("given")), F.lit(""))).withColumn("host", F.when(F.col("_given").isNull(), U.host(F.col("book_url"))))
    rows = rows.join(by_url.select(F.col("_url").alias("_given"), F.col("_ord").alias("_by_given")), "_given", "left")
    if shelf is None:
        rows = rows.withColumn("_by_shelf", F.lit(None).cast("long"))
    else:
        origins = shelf.groupBy("book_url").agg(F.min(F.nullif(U.normalise(F.col("origin")), F.lit(""))).alias("_url")).join(by_url, "_url").select("book_url", F.col("_ord").alias("_by_shelf"))
        rows = rows.join(origins, "book_url", "left")
    rows = rows.join(sources_of_hosts(rows.where("_given is null and _by_shelf is null"), catalog).withColumnRenamed("source_ord", "_by_host"), "host", "left")
    local = F.when(is_local(F.col("given"), F.col("book_url")), F.when(F.coalesce("_given", "book_url").contains("epub"), LOCAL[1]).otherwise(LOCAL[0]))
    ord_ = F.when(F.col("_local").isNull(), F.when(F.col("_given").isNotNull(), F.col("_by_given")).otherwise(F.coalesce("_by_shelf", "_by_host")))
    how = F.when(F.col("_local").isNotNull(), "local").when(F.col("_by_given").isNotNull(), "given").when(F.col("_given").isNotNull(), F.lit(None)).when(F.col("_by_shelf").isNotNull(), "shelf").when(F.col("_by_host").isNotNull(), "host")
    named = catalog.groupBy("source_ord").agg(F.min("source_url").alias("source_url"))
    found = rows.withColumn("_local", local).select(*books.columns, "_local", ord_.alias("source_ord"), how.alias("how"))
    return found.join(named, "source_ord", "left").select(*books.columns, "source_ord", F.coalesce("_local", "source_url").alias("source_url"), "how")

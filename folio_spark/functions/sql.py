"""The library in SQL: scalars as SQL functions that the optimizer inlines, the page shredder as a table function, and hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, arguments and body of each function.
SCALARS = {
    "url_host": ("url STRING", r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"),
    "root_label": ("host STRING", r"coalesce(try_element_at(split(host, '[.]'), -2), host)"),
    "collapse_space": ("t STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
    "merge_key": ("name STRING, author STRING", "concat_ws('|', lower(trim(coalesce(name, ''))), lower(trim(coalesce(author, ''))))"),
    "is_truthy": ("t STRING", "coalesce(lower(trim(t)) NOT IN ('', '0', 'false', 'null', 'none', 'no', 'off'), false)"),
    "in_group": ("bits BIGINT, wanted BIGINT", "wanted = -1 OR (wanted = 0 AND bits = 0) OR (wanted <> 0 AND (bits & wanted) <> 0)"),
    "unread": ("total INT, current INT", "greatest(0, total - 1 - current)"),
    "content_key": ("ns STRING, book STRING, chapter STRING", "concat_ws('/', ns, md5(book), concat(md5(chapter), '.txt'))"),
    "plain_length": ("html STRING", r"length(regexp_replace(regexp_replace(html, '<[^>]*>', ''), '\\s+', ''))"),
    "source_groups": ("t STRING", "array_distinct(filter(transform(split(t, '[,;；、]'), x -> trim(x)), x -> x <> ''))"),
}


def register(spark: SparkSession, prefix: str = "folio_") -> list[str]:
    """Temporary SQL functions of all scalars, and the table function `shred_pages(TABLE(page_id, html))`, which
    takes and gives Arrow batches. Returns their names."""
    for name, (arguments, body) in SCALARS.items():
        returns = "BOOLEAN" if name in ("is_truthy", "in_group") else "INT" if name in ("unread", "plain_length") else "ARRAY<STRING>" if name == "source_groups" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {body}")

    spark.udtf.register(f"{prefix}shred_pages", _table_function())
    return [f"{prefix}{n}" for n in (*SCALARS, "shred_pages")]


def _table_function():
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf

    names = ("last", "parent", "depth", "child_ix", "tag", "attrs")

    @arrow_udtf(returnType="page_id bigint, pre int, last int, parent int, depth int, child_ix int, tag string, attrs map<string,string>")
    class ShredPages:
        """Elements of pages: batches of (page_id, html) in, batches of elements out."""

        def eval(self, pages: pa.RecordBatch):
            from folio_spark.operators.shred import shred_page

            kinds = {"tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string())}
            for page, html in zip(pages.column(0).to_pylist(), pages.column(1).to_pylist(), strict=True):
                rows = shred_page(html)[0]
                at = {n: i for i, n in enumerate(("last", "parent", "depth", "child_ix", "tag", "attrs"))}
                columns = {n: pa.array([list(r[at[n]].items()) if n == "attrs" else r[at[n]] for r in rows], kinds.get(n, pa.int32())) for n in names}
                yield pa.table({"page_id": pa.array([page] * len(rows), pa.int64()), "pre": pa.array(range(len(rows)), pa.int32()), **columns})

    return ShredPages


Hook = Callable[..., Column]


def with_hooks(rows: DataFrame, **hooks: tuple[Hook, list[str]]) -> DataFrame:
    """rows with columns changed by hooks of the caller: name=(function of columns, their names). A hook is any function of
    columns, an Arrow or pandas UDF too: a title's formatter over (idx, title), what a page's body passes through, a list's filter."""
    return rows.withColumns({name: hook(*(F.col(c) for c in inputs)) for name, (hook, inputs) in hooks.items()})

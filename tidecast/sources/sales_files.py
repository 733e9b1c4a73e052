"""Sales history from files: reading, matching of headers, cleaning to canonical rows, and a summary with issues."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import to_month
from tidecast.functions.text import code
from tidecast.sources.tables import checkpointed

#: What may divide and enclose fields, the likeliest first, and how many lines of a file tell.
DELIMITERS, QUOTES, SNIFFED = (",", "\t", ";", "|"), ('"', "'"), 1000
LIMIT_SERIES, LEAST_MONTHS, GOOD_MONTHS, BAD_DATES = 600, 18, 30, 0.05

# The fields of each kind of file, and the headers that they go by.
FIELDS = {
    "sales": {"required": ["month", "customer", "product", "units"], "optional": ["revenue", "price", "region", "oem", "family"]},
    "mapping": {"required": ["customer", "oem"], "optional": ["region", "allocation_pct"]},
    "backlog": {"required": ["snapshot_month", "delivery_month", "customer", "product", "units"], "optional": ["value"]},
    "capacity": {"required": ["month", "region", "product", "capacity_units"], "optional": []},
}
HEADERS = {
    "month": ["month", "date", "period", "order_date", "invoice_date", "ship_date", "ds", "yearmonth", "year_month", "posting_date"],
    "snapshot_month": ["snapshot_month", "snapshot", "as_of", "asof", "snapshot_date"],
    "delivery_month": ["delivery_month", "delivery", "ship_month", "delivery_date", "due_month", "due_date"],
    "customer": ["customer", "sold_to", "soldto", "sold_to_name", "account", "client", "customer_name", "buyer", "store", "store_id", "dealer", "distributor"],
    "product": ["product", "sku", "item", "part", "product_code", "product_line", "material", "dept", "dept_id", "item_id"],
    "family": ["family", "category", "cat", "cat_id", "product_family", "segment"],
    "units": ["units", "qty", "quantity", "volume", "units_sold", "shipped_units", "sales_units", "sold"],
    "revenue": ["revenue", "sales", "sales_usd", "amount", "net_sales", "sales_amount", "value", "net_revenue", "invoice_amount", "sales_value", "turnover"],
    "price": ["price", "unit_price", "asp", "sell_price", "avg_price"],
    "region": ["region", "territory", "geo", "area", "state", "state_id", "country", "market"],
    "oem": ["oem", "brand", "end_customer", "parent", "parent_customer", "ultimate_parent", "group", "customer_group"],
    "allocation_pct": ["allocation_pct", "allocation", "share", "pct", "percent", "split"],
    "value": ["value", "backlog_value", "amount", "revenue"],
    "capacity_units": ["capacity_units", "capacity", "cap", "max_units"],
}


def dialects(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """file, delimiter, quote, fields, share: how each file's lines are divided, of ``DELIMITERS`` and ``QUOTES``.

    A line's fields are counted outside quoted ones (those that begin and end beside a delimiter or the line's ends). The best pair is that by which most lines have the file's commonest number of
    fields, two or more; then that with more quoted lines, with more fields, the first named. A file that nothing divides has commas, one field. Empty lines tell nothing."""
    rows = lines.filter(F.trim(F.coalesce(line, F.lit(""))) != "").select(F.col(file).alias("file"), F.regexp_replace(line, r"\r$", "").alias("line"))
    tried = []
    for i, d in enumerate(DELIMITERS):
        for j, q in enumerate(QUOTES):
            at = re.escape(d)
            quoted = rf"(?<=^|{at}){q}(?:[^{q}]|{q}{q})*{q}(?=$|{at})"
            bare = F.regexp_replace("line", quoted, "")
            fields = F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1
            tried.append(F.struct(F.lit(i * len(QUOTES) + j).alias("place"), F.lit(d).alias("delimiter"), F.lit(q).alias("quote"), fields.alias("fields"), F.col("line").rlike(quoted).cast("long").alias("quoted")))
    each = rows.select("file", F.explode(F.array(*tried)).alias("t")).select("file", "t.*")
    counts = each.groupBy("file", "place", "delimiter", "quote", "fields").agg(F.count(F.lit(1)).alias("n"), F.sum("quoted").alias("quoted"))
    pairs = counts.groupBy("file", "place", "delimiter", "quote").agg(
        F.max(F.struct("n", "fields")).alias("most"), F.sum("n").alias("lines"), F.sum("quoted").alias("quoted")
    )
    divides = F.col("most.fields") > 1
    share = F.when(divides, F.col("most.n") / F.col("lines")).otherwise(0.0)
    best = F.max_by(F.struct("delimiter", "quote", F.col("most.fields").alias("fields"), (F.col("most.n") / F.col("lines")).alias("share"), divides.alias("divides")), F.struct(share, F.when(divides, F.col("quoted")).otherwise(0), "most.fields", -F.col("place")))
    found = pairs.groupBy("file").agg(best.alias("b")).select("file", "b.*")
    none = lambda c, other: F.when(F.col("divides"), F.col(c)).otherwise(other).alias(c)
    return found.select("file", none("delimiter", DELIMITERS[0]), none("quote", QUOTES[0]), none("fields", 1), none("share", 1.0))


def read_table(spark: SparkSession, path: str, rows: int | None = None, delimiter: str | None = None, quote: str | None = None) -> DataFrame:
    """A table by its file's ending: Parquet, or text with a header; ``rows`` limits a preview. Delimiter and quote, if not given, are told by ``dialects`` from the first ``SNIFFED`` lines."""
    ending = re.search(r"\.([a-z0-9]+)(?:\.gz)?$", path.lower())
    kind = ending[1] if ending else ""
    if kind in ("parquet", "pq"):
        df = spark.read.parquet(path)
    elif kind in ("csv", "txt", "tsv", "gz"):
        if delimiter is None or quote is None:
            told = dialects(spark.read.text(path).limit(SNIFFED).select(F.lit(path).alias("file"), F.col("value").alias("line"))).first()
            delimiter = delimiter or (told.delimiter if told else "\t" if kind == "tsv" else DELIMITERS[0])
            quote = quote or (told.quote if told else QUOTES[0])
        df = spark.read.csv(path, header=True, sep=delimiter, quote=quote, escape=quote, mode="PERMISSIVE")
    else:
        raise ValueError(f"unsupported file type '{kind}'")
    return df.limit(rows) if rows else df


def unpack(path: str, folder: str | None = None) -> str:
    """The largest table in a zip file, written to ``folder`` (one that executors can read) under its plain name."""
    with zipfile.ZipFile(path) as z:
        tables = [m for m in z.infolist() if re.search(r"\.(csv|tsv|parquet)$", m.filename.lower())]
        if not tables:
            raise ValueError("the archive has no csv, tsv or parquet file")
        best = max(tables, key=lambda m: m.file_size)
        out = os.path.join(folder or tempfile.mkdtemp(prefix="spark-"), re.sub(r"[^A-Za-z0-9._-]+", "_", os.path.basename(best.filename)))
        with z.open(best) as src, open(out, "wb") as dst:
            while block := src.read(1 << 20):
                dst.write(block)
    return out


def suggest_columns(role: str, columns: list[str]) -> dict[str, str | None]:
    """For each field the column that its header names: an equal header first, then one that contains a name; no column twice."""
    keyed = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in columns}
    free = dict(keyed)
    out: dict[str, str | None] = {}
    for field in (*FIELDS[role]["required"], *FIELDS[role]["optional"]):
        names = HEADERS[field]
        key = next((n for n in names if n in free), None) or next((k for n in names for k in free if n in k), None)
        out[field] = free.pop(key) if key is not None else None
    return out


def drop_partial_month(df: DataFrame, day: str, month: str = "month") -> DataFrame:
    """Without the last month, if rows are finer than months and the last day of the month isn't reached."""
    ends = df.agg(F.max(day).alias("_last"), F.count_if(F.dayofmonth(day) != 1).alias("_fine"))
    keep = (F.col("_fine") == 0) | (F.col("_last") == F.last_day("_last")) | (F.col(month) < F.trunc("_last", "MM"))
    return df.crossJoin(F.broadcast(ends)).filter(keep).select(df.columns)  # one row of bounds


def _field(df: DataFrame, columns: dict[str, str | None], name: str) -> Column | None:
    source = columns.get(name)
    if not source:
        if name in FIELDS["sales"]["required"]:
            raise ValueError(f"no column is given for '{name}'")
        return None
    if source not in df.columns:
        raise ValueError(f"column '{source}', given for {name}, is not in the table")
    return F.col(f"`{source}`")


def _coerced(df: DataFrame, columns: dict[str, str | None], constant_price: float | None, default_region: str, date_format: str | None) -> DataFrame:
    text = lambda c: F.trim(c.cast("string"))
    units = _field(df, columns, "units").try_cast("double")
    revenue, price = _field(df, columns, "revenue"), _field(df, columns, "price")
    if revenue is not None:
        money = revenue.try_cast("double")
    elif price is not None:
        money = F.coalesce(units * price.try_cast("double"), F.lit(0.0))
    elif constant_price is not None:
        money = F.coalesce(units * constant_price, F.lit(0.0))
    else:
        money = F.lit(0.0)
    raw = _field(df, columns, "month")
    day = F.to_date(F.try_to_timestamp(raw.cast("string"), F.lit(date_format))) if date_format else raw.try_cast("date")
    customer = text(_field(df, columns, "customer"))
    region, oem, family = (_field(df, columns, x) for x in ("region", "oem", "family"))
    return df.select(
        day.alias("day"),
        customer.alias("customer"),
        text(_field(df, columns, "product")).alias("product"),
        (text(region) if region is not None else F.lit(default_region)).alias("region"),
        (text(oem) if oem is not None else customer).alias("oem"),
        (text(family) if family is not None else F.lit("All")).alias("family"),
        units.alias("units"),
        money.alias("revenue"),
    )


def canonical_sales(df: DataFrame, columns: dict[str, str | None], constant_price: float | None = None, default_region: str = "Global", date_format: str | None = None) -> DataFrame:
    """month, customer, product, region, oem, family, units, revenue.

    Revenue is the revenue column, else units times price, else units times the constant price. Rows whose date, units or revenue can't be read, or
    without customer or product, are dropped, as is an incomplete last month. Without an oem column each customer is its own."""
    rows = _coerced(df, columns, constant_price, default_region, date_format)
    rows = rows.filter("day is not null and units is not null and revenue is not null and customer <> '' and product <> ''")
    rows = drop_partial_month(rows.withColumn("month", to_month(F.col("day"))), "day")
    return rows.select("month", "customer", "product", "region", "oem", "family", "units", "revenue")


def sales_issues(df: DataFrame, columns: dict[str, str | None], constant_price: float | None = None, date_format: str | None = None) -> DataFrame:
    """level, issue, n: what cleaning finds, from one pass over the rows."""
    rows = _coerced(df, columns, constant_price, "Global", date_format)
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("day").isNull()).alias("bad_date"),
        F.count_if(F.col("units").isNull()).alias("bad_units"),
        F.count_if(F.col("units") < 0).alias("negative_units"),
        F.count_if(F.col("day").isNotNull() & F.col("units").isNotNull() & F.col("revenue").isNotNull() & (F.col("customer") != "") & (F.col("product") != "")).alias("usable"),
    )
    priced = bool(columns.get("revenue") or columns.get("price") or constant_price is not None)
    issue = lambda level, name, n, when: F.when(when, F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(name).alias("issue"), n.cast("long").alias("n")))
    every = F.array_compact(
        F.array(
            issue(F.when(F.col("bad_date") > BAD_DATES * F.col("n"), "error").otherwise("warn"), "unreadable date", F.col("bad_date"), F.col("bad_date") > 0),
            issue("warn", "units are no number", F.col("bad_units"), F.col("bad_units") > 0),
            issue("warn", "negative units", F.col("negative_units"), F.col("negative_units") > 0),
            issue("error", "no revenue, price or constant price", F.col("n"), F.lit(not priced)),
            issue("error", "no usable row", F.col("n"), F.col("usable") == 0),
        )
    )
    return found.select(F.explode(every).alias("i")).select("i.*")


def summarize_sales(c: DataFrame) -> DataFrame:
    """One row about canonical rows: counts, first and last month, totals, share without revenue, repeated keys."""
    key = ("month", "customer", "product", "region", "oem")
    keys = c.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = keys.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    total = c.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("month").alias("n_months"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct("customer").alias("customers"),
        F.count_distinct("oem").alias("oems"),
        F.count_distinct("region").alias("regions"),
        F.count_distinct("product").alias("products"),
        F.count_distinct("oem", "region", "product").alias("n_series"),
        F.sum(F.col("units").cast("decimal(18,4)")).cast("double").alias("units_total"),
        F.sum(F.col("revenue").cast("decimal(18,4)")).cast("double").alias("revenue_total"),
        (F.count_if(F.col("revenue") <= 0) / F.count(F.lit(1))).alias("share_without_revenue"),
    )
    return total.crossJoin(F.broadcast(repeated))  # a row each


def summary_issues(summary: DataFrame, limit_series: int = LIMIT_SERIES) -> DataFrame:
    """level, issue of a summary."""
    m, s = F.col("n_months"), F.col("n_series")
    issue = lambda level, name, when: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(name).alias("issue")))
    every = F.array_compact(
        F.array(
            issue("error", f"fewer than {LEAST_MONTHS} months", m < LEAST_MONTHS),
            issue("warn", f"fewer than {GOOD_MONTHS} months", (m >= LEAST_MONTHS) & (m < GOOD_MONTHS)),
            issue("error", f"more than {limit_series} series", s > limit_series),
            issue("warn", "many series", (s > limit_series // 2) & (s <= limit_series)),
            issue("warn", "most rows have no revenue", F.col("share_without_revenue") > 0.5),
            issue("info", "repeated rows will be summed", F.col("duplicates") > 0),
        )
    )
    return summary.select(F.explode(every).alias("i")).select("i.*")


def wide_to_long(sales: DataFrame, calendar: DataFrame, prices: DataFrame, ids: tuple[str, ...], product: str, store: str = "store_id", item: str = "item_id", state: str = "state_id", family: str = "cat_id") -> DataFrame:
    """month, customer, oem, region, product, family, units, revenue of a table with a column for each day (``d_1`` on).

    ``calendar`` has d, date, wm_yr_wk; ``prices`` has store, item, wm_yr_wk, sell_price; a missing price counts as zero. An incomplete last month is dropped."""
    days = [c for c in sales.columns if re.fullmatch(r"d_\d+", c)]
    rows = sales.unpivot(list(ids), days, "d", "units")
    rows = rows.join(calendar.select("d", F.col("date").cast("date").alias("day"), "wm_yr_wk"), "d")
    rows = rows.join(prices.select(store, item, "wm_yr_wk", "sell_price"), [store, item, "wm_yr_wk"], "left")
    ends = calendar.filter(F.col("d").isin(days)).agg(F.max(F.col("date").cast("date")).alias("_last"))
    rows = rows.withColumn("month", to_month(F.col("day"))).crossJoin(F.broadcast(ends)).filter("_last = last_day(_last) or month < trunc(_last, 'MM')")
    value = F.col("units") * F.coalesce(F.col("sell_price"), F.lit(0.0))
    return rows.groupBy("month", F.col(store).alias("customer"), F.col(state).alias("region"), F.col(product).alias("product"), F.col(family).alias("family")).agg(
        F.sum("units").alias("units"), F.sum(value).alias("revenue")
    ).withColumn("oem", F.col("customer"))


def stable_codes(values: DataFrame, column: str, length: int) -> DataFrame:
    """column, code: a code of its own for each distinct value; values in order, the second and later of one code get ``_2`` and so on.

    Where a numbered code is another value's own (or cutting makes two equal), the later value takes further numbers of its code, in rounds until all differ."""
    todo = checkpointed(values.select(column).distinct().select(column, code(F.col(column), length).alias("_base"), F.lit(0).alias("_from")))
    done = None
    while done is None or not todo.isEmpty():
        rows = todo.withColumn("_n", F.col("_from") + F.row_number().over(Window.partitionBy("_base").orderBy(column)))
        end = F.concat(F.lit("_"), F.col("_n").cast("string"))
        named = rows.withColumn("code", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.substring("_base", F.lit(1), F.lit(length) - F.length(end)), end)))
        first = F.row_number().over(Window.partitionBy("code").orderBy("_n", column)) == 1
        tried = named.withColumn("_own", first)
        if done is not None:
            tried = tried.join(done.select("code", F.lit(True).alias("_taken")), "code", "left").withColumn("_own", F.col("_own") & F.col("_taken").isNull())
        tried = checkpointed(tried.withColumn("_from", F.max("_n").over(Window.partitionBy("_base"))))
        own = tried.filter("_own").select(column, "code")
        done = own if done is None else checkpointed(done.unionByName(own))
        todo = tried.filter("not _own").select(column, "_base", "_from")
    return done


def preview(df: DataFrame, page: int, size: int, *newest_first: Column) -> DataFrame:
    """A page of rows; ``size`` is kept within 1 to 200."""
    size = min(max(size, 1), 200)
    return df.orderBy(*newest_first).offset(max(page, 0) * size).limit(size)


def month_of(value: str) -> date:
    return date.fromisoformat(value).replace(day=1)

"""Panels: bars from trades, dense calendars, filters that reach the scan, and a factor store."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Orders the trades of a supplier within a bar without ties.
TRADE_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "month", key: str = "l_suppkey", by_code: bool = False) -> DataFrame:
    """(date, code, open, high, low, close, volume, money, vwap, trades) of line items: the price is the extended price, the instrument the supplier (or another key).

    With ``by_code`` trades are dealt out by code before they are grouped, so that windows of a code need no exchange or sort of their own: for bars
    of few trades, which a grouping before the exchange would not make fewer.
    """
    trades = table(spark, sf_dir, "lineitem").filter("l_shipdate is not null and l_extendedprice is not null")
    trade, price = F.struct(*TRADE_KEY), F.col("l_extendedprice")
    date = F.trunc("l_shipdate", unit) if unit in ("month", "year") else F.to_date(F.date_trunc(unit, "l_shipdate"))
    trades = (trades.repartition(key) if by_code else trades).withColumns({"date": date, "code": F.col(key)})
    out = trades.groupBy(*(("code", "date") if by_code else ("date", "code"))).agg(F.min(trade).getField("l_extendedprice").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(trade).getField("l_extendedprice").alias("close"), F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.sum(price), 2).alias("money"), F.count("*").alias("trades"))
    return out.select("date", "code", *out.columns[2:], F.try_divide("money", "volume").alias("vwap"))


def first_of_duplicates(panel: DataFrame, *order: str) -> DataFrame:
    """One row for each (date, code): the first by the given columns."""
    w = Window.partitionBy("date", "code").orderBy(*order)
    return panel.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def densify(panel: DataFrame, unit: str = "month") -> DataFrame:
    """A row for every code and every date of a regular calendar; what was missing is null.

    Each code explodes the calendar between the panel's ends, so there is no cross join.  Codes and ends are read from the panel's source
    apart, a column each, without grouping it first.
    """
    ends = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    step = F.expr(f"interval 1 {unit}")
    codes = panel.select("code").distinct().join(F.broadcast(ends), how="inner")  # one row
    spine = codes.select(F.explode(F.sequence("lo", "hi", step)).alias("date"), "code")
    return spine.join(panel, ["date", "code"], "left")


def between(df: DataFrame, start=None, end=None, codes=None, columns=None, date: str = "date") -> DataFrame:
    """Dates in [start, end], the codes and columns asked for; all of it reaches the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end))
    if codes is not None:
        df = df.filter(F.col("code").isin(list(codes)))
    return df.select(*columns) if columns else df


def adjusted(bars_: DataFrame, factor: str = "factor") -> DataFrame:
    return bars_.withColumns({f"adj_{c}": F.col(c) * F.col(factor) for c in ("open", "high", "low", "close")})


def with_price_forms(bars_: DataFrame, prefix: str = "") -> DataFrame:
    """Mean prices of a bar: ohlc4, ohl3, ohc3, hl2, oc2."""
    o, h, lo, c = (F.col(f"{prefix}{x}") for x in ("open", "high", "low", "close"))
    return bars_.withColumns({f"{prefix}ohlc4": (o + h + lo + c) / 4, f"{prefix}ohl3": (o + h + lo) / 3, f"{prefix}ohc3": (o + h + c) / 3, f"{prefix}hl2": (h + lo) / 2, f"{prefix}oc2": (o + c) / 2})


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, industry, sector): nation and region of a supplier."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.col("n_regionkey").alias("sector"))


def explode_membership(df: DataFrame, members: str = "members") -> DataFrame:
    """(date, code) of a map column from date to an array of codes."""
    return df.select(F.explode(members).alias("date", "codes")).select("date", F.explode("codes").alias("code"))


#: A note of the factor store's catalog; a null n marks a factor that was deleted.
NOTE = "name string, version long, parts array<string>, n long, first_date date, last_date date, values_hash string, days double, upload_time timestamp, batch string, notes string"


class FactorStore:
    """Versions of factors: parts that are never changed, and a catalog of notes that name a version's parts.

    A version is written first and noted last, by one file that appears whole, so the note is what makes it
    current: a write that fails leaves the version before it as it was, and a reader sees one version or the other.  Values are
    Parquet, partitioned by year.  Writers of one factor take turns; of two at once the later note counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, values: DataFrame, **notes: str) -> None:
        """Keeps (date, code, value) as the factor's next version, and notes its hash, range and frequency."""
        self._publish(name, [self._part(name, values)], notes)

    def append(self, name: str, values: DataFrame, batch: str | None = None, **notes: str) -> None:
        """A version with the rows newer than the last date kept besides; a factor that is not kept is saved.

        The rows of a ``batch`` are taken whatever their dates, but once: one that a version of the factor has taken is not taken again, so
        that a stream may repeat it.
        """
        if batch is not None and not self._notes().filter((F.col("name") == name) & (F.col("batch") == batch)).isEmpty():
            return
        now = self._current(name)
        if batch is None and now is not None and now.last_date is not None:
            values = values.filter(F.col("date") > F.lit(now.last_date))
        self._publish(name, [*(now.parts if now is not None else []), self._part(name, values)], notes, batch)

    def load(self, name: str, start=None, end=None, codes=None, version: int | None = None) -> DataFrame:
        """The current version, or the one of a number, which stays until it is pruned."""
        note = self._current(name) if version is None else self._notes().filter((F.col("name") == name) & (F.col("version") == version) & F.col("n").isNotNull()).orderBy(F.desc("upload_time")).first()
        if note is None:
            raise KeyError(f"{name} is not kept" if version is None else f"{name} has no version {version}")
        return between(self._read(note.parts), start, end, codes)

    def versions(self, name: str) -> DataFrame:
        """The notes of a factor, also of its ends."""
        return self._notes().filter(F.col("name") == name)

    def _part(self, name: str, values: DataFrame) -> str:
        part = f"values/{name}/{uuid.uuid4().hex}"
        values.select("date", "code", "value").withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{self.root}/{part}")
        return part

    def _read(self, parts: list[str]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.root}/{p}").select("date", "code", "value") for p in parts]
        return functools.reduce(DataFrame.unionByName, frames)

    def _publish(self, name: str, parts: list[str], notes: dict, batch: str | None = None) -> None:
        kept = self._read(parts)
        gap = kept.select("date").distinct().select(F.datediff("date", F.lag("date").over(Window.orderBy("date"))).alias("gap"))
        row = kept.agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.xxhash64("date", "code", "value").cast("decimal(38,0)")).cast("string").alias("values_hash"))
        row = row.join(gap.agg(F.median("gap").alias("days")), how="inner").first()
        last = self.versions(name).agg(F.max("version")).first()[0]
        self._note((name, (last or 0) + 1, parts, row.n, row.first_date, row.last_date, row.values_hash, row.days, batch, str(sorted(notes.items()))))

    def _note(self, row: tuple) -> None:
        fields = [f for f in StructType.fromDDL(NOTE).fields if f.name != "upload_time"]
        note = self.spark.createDataFrame([row], StructType(fields)).withColumn("upload_time", F.current_timestamp())
        note.select(*StructType.fromDDL(NOTE).names).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    def _notes(self) -> DataFrame:
        try:
            self.spark.catalog.refreshByPath(f"{self.root}/catalog")
            return self.spark.read.schema(NOTE).parquet(f"{self.root}/catalog")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], NOTE)

    def catalog(self) -> DataFrame:
        """The newest note of each factor that is kept."""
        w = Window.partitionBy("name").orderBy(F.desc("version"), F.desc("upload_time"))
        return self._notes().withColumn("_n", F.row_number().over(w)).filter("_n = 1 and n is not null").drop("_n")

    def _current(self, name: str):
        return self.catalog().filter(F.col("name") == name).first()

    def has(self, name: str) -> bool:
        return self._current(name) is not None

    def delete(self, name: str) -> None:
        """Ends the factor by a note; its versions stay until they are pruned."""
        now = self._current(name)
        if now is not None:
            self._note((name, now.version + 1, [], None, None, None, None, None, None, "[]"))

    def prune(self, name: str, keep: int = 1) -> list[str]:
        """Removes the parts that none of the last ``keep`` notes of the factor names, and gives them; also those of writes that failed."""
        newest = self.versions(name).orderBy(F.desc("version"), F.desc("upload_time")).limit(keep).collect()
        used = {p for r in newest if r.n is not None for p in r.parts}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/values/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(folder) if files.exists(folder) else ():
            part = f"values/{name}/{status.getPath().getName()}"
            if part not in used:
                files.delete(status.getPath(), True)
                gone.append(part)
        return sorted(gone)

    def sync(self, other: FactorStore) -> list[str]:
        """Copies to ``other`` the factors that it lacks or whose values differ there, and gives their names."""
        there = other.catalog().select("name", "values_hash")
        names = sorted(r.name for r in self.catalog().join(there, ["name", "values_hash"], "left_anti").select("name").collect())
        for name in names:
            other.save(name, self.load(name))
        return names

    def cached(self, name: str, make: Callable[[], DataFrame], seconds: float) -> DataFrame:
        """The factor as kept if it was saved within so many seconds, else as made and saved now."""
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("upload_time")
        if self.catalog().filter((F.col("name") == name) & (age <= seconds)).isEmpty():
            self.save(name, make())
        return self.load(name)

    def remembered(self, make: Callable[..., DataFrame], *args, seconds: float = 7 * 86400, **named) -> DataFrame:
        """``make(*args, **named)``, kept for so many seconds under the hash of the function's code and of all arguments; frames count by their rows."""
        return self.cached(f"call-{call_hash(make, *args, **named)}", lambda: make(*args, **named), seconds)


def content_hash(df: DataFrame) -> str:
    """A hash of a frame's columns and rows, in any order of rows and partitions."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    sums = df.select(row.alias("row")).agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")) for k in (1, 2)]).first()
    return hashlib.sha256(f"{df.schema.simpleString()}:{tuple(map(str, sums))}".encode()).hexdigest()


def _code_text(code) -> str:
    return repr((code.co_code.hex(), code.co_names, [_code_text(c) if hasattr(c, "co_code") else c for c in code.co_consts]))


def call_hash(make: Callable, *args, **named) -> str:
    """A hash of a function's code and of the values of its arguments."""
    parts = [_code_text(make.__code__), repr(make.__defaults__)]
    held = [c.cell_contents for c in make.__closure__ or ()]
    for value in [*held, *args, *(x for k in sorted(named) for x in (k, named[k]))]:
        parts.append(content_hash(value) if isinstance(value, DataFrame) else call_hash(value) if hasattr(value, "__code__") else f"{type(value).__name__}:{value!r}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def read_statements(df: DataFrame, start=None, end=None, fiscal_year: int | None = None, months: tuple[int, ...] | None = None, report_type: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Statements published in [start, end), of a fiscal year, of periods that end in some months, of a report type."""
    if start is not None:
        df = df.filter(F.col("pub_date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("pub_date") < F.lit(end))
    if fiscal_year is not None:
        df = df.filter(F.year("end_date") == fiscal_year)
    if months is not None:
        df = df.filter(F.month("end_date").isin(list(months)))
    if report_type is not None:
        df = df.filter(F.col("report_type") == report_type)
    return df.select(*columns) if columns else df


def at_close(df: DataFrame, hours: int = 15) -> DataFrame:
    """A panel of days dated by the time of their close."""
    return df.withColumn("date", F.col("date").cast("timestamp_ntz") + F.expr(f"interval {hours} hours"))


def explode_industries(df: DataFrame, industries_: str = "industries") -> DataFrame:
    """(date, code, industry) of a map column from industry to a map from date to an array of codes."""
    dated = df.select(F.explode(industries_).alias("industry", "members")).select("industry", F.explode("members").alias("date", "codes"))
    return dated.select("date", F.explode("codes").alias("code"), "industry")


def shift_dates(calendar: DataFrame, n: int) -> DataFrame:
    """(date, shifted): each trading date with the one n trading dates later (earlier if negative); null beyond the calendar, whose dates are few."""
    return calendar.select("date").distinct().withColumn("shifted", F.lead("date", n).over(Window.orderBy("date")))

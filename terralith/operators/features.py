"""Feature collections as DataFrames: an id, a geometry (WKT text or coordinates) and properties.

All functions are lazy and keep to built-in expressions.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def from_features(spark: SparkSession, features: list[tuple[str, str, dict]]) -> DataFrame:
    """(id, geom, properties) of (id, WKT, property map); int, float or text by the first value of each."""
    kinds: dict[str, T.DataType] = {}
    for _, _, p in features:
        for k, v in p.items():
            if v is not None and k not in kinds:
                kinds[k] = T.LongType() if isinstance(v, int) and not isinstance(v, bool) else T.DoubleType() if isinstance(v, float) else T.StringType()

    def fit(k: str, v):
        kind = kinds.get(k, T.StringType())
        return None if v is None else str(v) if isinstance(kind, T.StringType) else float(v) if isinstance(kind, T.DoubleType) else int(v)

    names = list(dict.fromkeys(k for _, _, p in features for k in p))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("geom", T.StringType()), *(T.StructField(k, kinds.get(k, T.StringType())) for k in names)])
    return spark.createDataFrame([(i, g, *(fit(k, p.get(k)) for k in names)) for i, g, p in features], schema)


_COMPARE = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "less_than": lambda c, v: c < v,
    "greater_than": lambda c, v: c > v,
    "not_less_than": lambda c, v: c >= v,
    "not_greater_than": lambda c, v: c <= v,
}
_TEXT = {
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
    "not_starts_with": lambda c, v: ~c.startswith(v),
    "not_ends_with": lambda c, v: ~c.endswith(v),
    "not_contains": lambda c, v: ~c.contains(v),
}


def filter_metadata(df: DataFrame, name: str, operator: str, value) -> DataFrame:
    """Rows whose property compares so with a value of the property's own type."""
    kind = df.schema[name].dataType
    if operator in _TEXT:
        if not isinstance(kind, T.StringType):
            raise TypeError(f"{operator} needs a text property")
        return df.where(_TEXT[operator](F.col(name), F.lit(value)))
    return df.where(_COMPARE[operator](F.col(name), F.lit(value).cast(kind)))


def filter_date(df: DataFrame, start: str, end: str, field: str = "time") -> DataFrame:
    """start < field < end, both ends excluded."""
    c = F.col(field)
    return df.where((c > F.lit(start).cast("timestamp")) & (c < F.lit(end).cast("timestamp")))


def select(df: DataFrame, properties: list[str], new: list[str] | None = None, geometry: str | None = "geom") -> DataFrame:
    """Properties, renamed if new names are given, with the geometry unless told not to."""
    if new is not None and len(new) != len(properties):
        raise ValueError("old and new names differ in number")
    keep = [geometry] if geometry and geometry in df.columns and geometry not in properties else []
    return df.select(*[F.col(a).alias(b) for a, b in zip(properties, new or properties)], *keep)


def constant_column(df: DataFrame, value, name: str = "constant") -> DataFrame:
    return df.withColumn(name, F.lit(value))


property_set = constant_column


def _numeric(df: DataFrame, *names: str) -> None:
    for n in names:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise TypeError(f"{n} isn't numeric")


def combine(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    _numeric(df, a, b)
    return df.withColumn(name, F.col(a) + F.col(b))


def subtract(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    _numeric(df, a, b)
    return df.withColumn(name, F.col(a) - F.col(b))


def assemble_array(df: DataFrame, properties: list[str], name: str = "array") -> DataFrame:
    """Numeric properties as one array of doubles; rows with a null among them go."""
    _numeric(df, *properties)
    return df.dropna(subset=properties).withColumn(name, F.array(*[F.col(p).cast("double") for p in properties]))


def random_column(df: DataFrame, name: str = "random", seed: int = 0, distribution: str = "uniform", keys: list[str] | None = None) -> DataFrame:
    """Random numbers; with keys they depend on the keys and the seed alone."""
    if not keys:
        return df.withColumn(name, F.randn(seed) if distribution == "normal" else F.rand(seed))

    def unit(salt: str) -> Column:
        h = F.md5(F.concat_ws("_", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in keys]).cast("binary"))
        return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    if distribution == "normal":
        return df.withColumn(name, F.sqrt(-2 * F.log(1 - unit("a"))) * F.cos(unit("b") * (2 * 3.141592653589793)))
    return df.withColumn(name, unit(""))


def distinct(df: DataFrame, properties: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Distinct rows, or of each property combination the first row by ``order``."""
    if not properties:
        return df.distinct()
    if order is None:
        return df.dropDuplicates(properties)
    first = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(p) for p in properties]).agg(F.min(first).alias("__f")).select(*[F.col(f"__f.{c}") for c in df.columns])


def remap(df: DataFrame, old: list, new: list, name: str) -> DataFrame:
    """Values by lookup; rows without a match go."""
    if len(old) != len(new):
        raise ValueError("old and new values differ in number")
    found = F.element_at(F.create_map(*[F.lit(x) for p in zip(old, new) for x in p]), F.col(name))
    return df.withColumn(name, found).where(F.col(name).isNotNull())


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("size"))


def sort(df: DataFrame, name: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(name).asc() if ascending else F.col(name).desc())


def limit(df: DataFrame, n: int, name: str | None = None, ascending: bool = True, then: str | None = None) -> DataFrame:
    """The first n rows in an order; ``then`` decides between equals."""
    if name:
        df = df.orderBy(F.col(name).asc() if ascending else F.col(name).desc(), *([F.col(then)] if then else []))
    return df.limit(n)


def extract_rows(df: DataFrame, count: int, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows number offset + 1 to offset + count in the key's order."""
    return df.orderBy(key).offset(offset).limit(count)


def map_(df: DataFrame, f, drop_nulls: bool = False) -> DataFrame:
    out = df.transform(f)
    return out.dropna() if drop_nulls else out


def sample(df: DataFrame, fraction: float, seed: int = 0, replace: bool = False) -> DataFrame:
    return df.sample(replace, fraction, seed)


def random_split(df: DataFrame, weights: list[float], seed: int = 0) -> list[DataFrame]:
    return df.randomSplit(weights, seed)


def merge_all(parts: list[DataFrame], key: str = "id", first: int = 1) -> DataFrame:
    """All rows of all parts, columns by name, ids with the part's number before them."""
    named = [p.withColumn(key, F.concat(F.lit(f"{i}_"), F.col(key).cast("string") if key in p.columns else F.monotonically_increasing_id().cast("string"))) for i, p in enumerate(parts, first)]
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merge(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return merge_all([a, b], key)


_AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": F.sum,
    "product": lambda c: F.product(F.when(F.col(c) != 0, F.col(c))),
    "sample_sd": F.stddev_samp,
    "sample_var": F.var_samp,
    "total_sd": F.stddev_pop,
    "total_var": F.var_pop,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


def aggregate(df: DataFrame, name: str, how: str) -> DataFrame:
    """One row, ``value``: min, max, mean, sum, product of non-zero values, sample_sd, ... of a numeric property."""
    _numeric(df, name)
    return df.agg(_AGGREGATES[how](name).alias("value"))


def aggregate_array(df: DataFrame, name: str, order: str) -> DataFrame:
    """All values, nulls too, in the order of a key."""
    return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v")))), lambda x: x["v"]).alias("value"))


def aggregate_first(df: DataFrame, name: str, order: str) -> DataFrame:
    return df.agg(F.min_by(name, order).alias("value"))


def stats(df: DataFrame, name: str) -> DataFrame:
    """sum, min, max, mean, sample and total sd and variance, in one pass."""
    _numeric(df, name)
    return df.agg(*[_AGGREGATES[k](name).alias(k) for k in ("sum", "min", "max", "mean", "sample_sd", "sample_var", "total_sd", "total_var")])


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """(property, count, mean, stddev, min, max), a row for each property, in one pass."""
    one = lambda n: F.struct(F.lit(n).alias("property"), F.count(n).alias("count"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("stddev"), F.min(n).cast("double").alias("min"), F.max(n).cast("double").alias("max"))
    return df.agg(F.array(*[one(n) for n in names]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def property_names(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(c,) for c in df.columns], "name string")


def aggregate_bounds(df: DataFrame, x0: str = "xmin", y0: str = "ymin", x1: str = "xmax", y1: str = "ymax") -> DataFrame:
    return df.agg(F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))


def geohash(x: Column, y: Column, precision: int = 10) -> Column:
    """Geohash of longitude and latitude, from bits of whole numbers."""
    n = 5 * precision
    nx, ny = (n + 1) // 2, n // 2
    cell = lambda v, low, span, bits: F.least(F.greatest(F.floor((v - low) / span * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    bx, by = F.lpad(F.bin(cell(x, -180.0, 360.0, nx)), nx, "0"), F.lpad(F.bin(cell(y, -90.0, 180.0, ny)), ny, "0")
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    woven = F.concat(*[F.substring(bx if i % 2 == 0 else by, i // 2 + 1, 1) for i in range(n)])
    char = lambda i: F.substring(F.lit(letters), F.conv(F.substring(woven, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[char(i) for i in range(precision)])


def with_row_number(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("row", F.row_number().over(Window.orderBy(key)))


def web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres of EPSG:3857 from degrees."""
    r = 6378137.0
    return F.radians(x) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2)) * r


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - 1.5707963267948966)


# --- single features: (id, geom, props map<string,string>) ---


def get(df: DataFrame, key: str) -> DataFrame:
    return df.select("id", F.try_element_at("props", F.lit(key)).alias("value"))


def get_number(df: DataFrame, key: str) -> DataFrame:
    return df.select("id", F.try_element_at("props", F.lit(key)).try_cast("double").alias("value"))


def get_string(df: DataFrame, key: str) -> DataFrame:
    """The value as text, empty where there is none."""
    return df.select("id", F.coalesce(F.try_element_at("props", F.lit(key)), F.lit("")).alias("value"))


def keys(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_sort(F.map_keys("props")).alias("names"))


def set_(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Properties with others put over them."""
    gone = F.map_filter("props", lambda k, v: ~k.isin(list(values)))
    return df.withColumn("props", F.map_concat(gone, F.create_map(*[F.lit(str(x)) for p in values.items() for x in p])))


def select_regex(df: DataFrame, pattern: str) -> DataFrame:
    """Properties whose whole name matches."""
    return df.withColumn("props", F.map_filter("props", lambda k, v: k.rlike(f"^(?:{pattern})$")))


def copy_properties(to: DataFrame, source: DataFrame, names: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Properties of the source row of the same id (the named ones, or all but some) over the target's."""
    p = F.map_filter("props", lambda k, v: k.isin(names)) if names else F.map_filter("props", lambda k, v: ~k.isin(exclude or []))
    j = to.join(source.select("id", p.alias("__p")), "id", "left").withColumn("__p", F.coalesce("__p", F.create_map().cast("map<string,string>")))
    own = F.map_filter("props", lambda k, v: ~F.array_contains(F.map_keys("__p"), k))
    return j.withColumn("props", F.map_concat(own, "__p")).drop("__p")


def to_array(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("id", F.array(*[F.try_element_at("props", F.lit(n)) for n in names]).alias("value"))


def to_dictionary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.select("id", (F.map_filter("props", lambda k, v: k.isin(names)) if names else F.col("props")).alias("value"))


def reproject(df: DataFrame, source: str, target: str, geom: str = "geom") -> DataFrame:
    """Geometries in another reference system."""
    from ..functions import geometry as G

    return df.withColumn(geom, G.shape("reproject", source, target)(geom))


def set_geometry(df: DataFrame, wkt: str, geom: str = "geom") -> DataFrame:
    return df.withColumn(geom, F.lit(wkt))

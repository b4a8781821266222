"""Messy tables with their truth: typed rows of six domains, and seeded corruption of known kinds.

Each value is a function of its row's number and a seed, by hashing, so that any partition of any size
gives the same table.  Beside each dirtied column the frame keeps the clean one and a mark of what was
done, so a repair can be scored cell by cell without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions import text as t

# Names and categories of the domains.
FIRST = "Ana Ben Chloe Dev Elif Farid Grace Hugo Ines Jonas Kira Liam Mona Noor Omar Priya".split()
LAST = "Abel Brandt Costa Diaz Engel Fischer Garcia Haas Ito Jensen Khan Lopez Meyer Novak Okoye Patel".split()
TOKENS = ("N/A", "null", "-", "unknown", "", "NaN", "missing")
TRUTH = (("yes", "no"), ("Y", "N"), ("TRUE", "False"), ("1", "0"))
EPOCH = "2020-01-01"
#: Units that some raw files use instead: ending of the column's name: (unit, how many of it are one of the column's).
UNITS = {"_kg": ("lb", 2.20462), "_cm": ("in", 0.393701)}

#: domain: column: (kind, argument, may be null, name at the source)
DOMAINS: dict[str, dict[str, tuple]] = {
    "customers": {
        "customer_id": ("id", "C", False, "customerId"), "full_name": ("name", None, False, None), "email": ("email", None, True, None), "age": ("int", (18, 90), True, None),
        "signup_date": ("date", 2000, False, "SignupDate"), "plan": ("category", ("free", "pro", "enterprise"), False, None), "is_active": ("bool", None, False, "isActive"),
        "city": ("category", ("Berlin", "Austin", "Lagos", "Pune", "Lima"), False, None), "lifetime_value": ("money", (0, 9000), True, "LTV_usd"),
    },
    "orders": {
        "order_id": ("id", "O", False, "OrderID"), "customer_id": ("id", "C", False, None), "order_date": ("date", 1500, False, None), "quantity": ("int", (1, 40), False, "qty"),
        "unit_price": ("money", (1, 900), False, "unitPrice"), "status": ("category", ("shipped", "pending", "returned"), False, None), "is_gift": ("bool", None, False, "IsGift"), "country": ("category", ("DE", "US", "IN", "BR"), False, None),
    },
    "patients": {
        "patient_id": ("id", "P", False, None), "birth_date": ("date", 2000, False, "dob"), "height_cm": ("float", (140, 205), False, "HeightCm"), "weight_kg": ("float", (40, 130), True, None),
        "visit_date": ("date", 900, False, None), "department": ("category", ("cardiology", "oncology", "surgery"), False, None), "smoker": ("bool", None, True, None), "systolic_bp": ("int", (90, 190), True, "systolicBP"),
    },
    "sensors": {
        "sensor_id": ("id", "S", False, None), "reading_time": ("datetime", 300, False, "readingTime"), "temperature_c": ("float", (-20, 45), True, "Temperature_C"),
        "humidity_pct": ("float", (5, 99), True, None), "status": ("category", ("ok", "warn", "fail"), False, None), "battery_level": ("int", (0, 100), False, "batteryLevel"),
    },
    "employees": {
        "employee_id": ("id", "E", False, "EmployeeId"), "full_name": ("name", None, False, None), "hire_date": ("date", 2000, False, "HireDate"), "salary": ("money", (30000, 190000), False, None),
        "department": ("category", ("sales", "engineering", "support"), False, None), "is_remote": ("bool", None, False, "remote"), "rating": ("int", (1, 5), True, None), "office": ("category", ("Oslo", "Paris", "Quito"), False, None),
    },
    "products": {
        "sku": ("id", "K", False, None), "product_name": ("name", None, False, "ProductName"), "category": ("category", ("home", "garden", "toys"), False, None), "price": ("money", (1, 700), False, None),
        "stock": ("int", (0, 500), True, None), "launch_date": ("date", 1800, False, "launchDate"), "discontinued": ("bool", None, False, "isDiscontinued"), "rating": ("float", (1, 5), True, None),
    },
}

#: kind: type in a target schema
TYPES = {"id": "string", "name": "string", "email": "string", "int": "int", "float": "float", "money": "float", "date": "date", "datetime": "datetime", "category": "category", "bool": "bool"}


@dataclass
class Messy:
    """clean and dirty share _rid; marks has for each column what was done to the cell, null for nothing."""

    domain: str
    clean: DataFrame
    dirty: DataFrame
    marks: DataFrame
    renames: dict[str, str]
    injected: set[tuple[str, str]] = field(default_factory=set)


def _number(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("_rid")), F.lit(n))


def _share(seed: int, salt: str) -> Column:
    return _number(seed, salt, 1_000_000) / 1_000_000


def _pick(options: tuple | list, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (n + 1).cast("int"))


def _value(c: str, kind: str, arg, seed: int) -> Column:
    n = lambda k, salt="": _number(seed, c + salt, k)
    if kind == "id":
        return F.concat(F.lit(arg), F.lpad((F.col("_rid") + 1).cast("string"), 7, "0"))
    if kind in ("name", "email"):
        first, last = _pick(FIRST, n(len(FIRST), "first")), _pick(LAST, n(len(LAST), "last"))
        return F.concat(first, F.lit(" "), last) if kind == "name" else F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("_rid"), F.lit("@example.org"))
    if kind == "int":
        return (n(arg[1] - arg[0] + 1) + arg[0]).cast("bigint")
    if kind in ("float", "money"):
        return F.round(F.lit(float(arg[0])) + n((arg[1] - arg[0]) * 100) / 100, 2)
    if kind == "date":
        return F.date_add(F.lit(EPOCH).cast("date"), n(arg).cast("int")).cast("timestamp_ntz")
    if kind == "datetime":
        return F.timestamp_add("MINUTE", n(arg * 1440).cast("int"), F.lit(EPOCH).cast("timestamp_ntz"))
    if kind == "category":
        return _pick(arg, n(len(arg)))
    return n(2) == 1


def generate(spark: SparkSession, domain: str, rows: int, seed: int) -> DataFrame:
    """A domain's clean rows, typed, with _rid."""
    df = spark.range(rows).withColumnRenamed("id", "_rid")
    out = []
    for c, (kind, arg, nullable, _) in DOMAINS[domain].items():
        v = _value(c, kind, arg, seed)
        out.append((F.when(_share(seed, c + "null") >= 0.05, v) if nullable else v).alias(c))
    return df.select("_rid", *out)


def _as_text(kind: str, c: Column) -> Column:
    if kind in ("float", "money"):
        return c.cast("decimal(18,2)").cast("string")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "datetime":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.initcap(c.cast("string")) if kind == "bool" else c.cast("string")


def _styled(c: str, kind: str, v: Column, seed: int, dates: str) -> Column:
    """A value as one of the ways a raw file writes it."""
    n = lambda k, salt: _number(seed, c + salt, k)
    plain = _as_text(kind, v)
    if kind in ("int", "float", "money"):
        styles = {"int": [plain, F.concat(plain, F.lit(" units"))], "float": [plain, F.concat(plain, F.lit(" kg"))], "money": [plain, F.concat(F.lit("$"), F.format_number(v.cast("double"), 2)), F.concat(F.lit("USD "), plain)]}[kind]
        return _choose(styles, n(len(styles), "style"))
    if kind == "date" and dates != "iso":
        slash = "M/d/yyyy" if dates == "mixed_us" else "d/M/yyyy"
        return _choose([plain, F.date_format(v, slash), F.date_format(v, "d MMM yyyy")], n(3, "style"))
    if kind == "bool":
        return _choose([F.when(v, F.lit(a)).otherwise(F.lit(b)) for a, b in TRUTH], n(len(TRUTH), "style"))
    if kind == "category":
        return _choose([plain, F.upper(plain), F.initcap(plain)], F.greatest(F.lit(0), n(10, "style") - 7))
    return plain


def _choose(options: list[Column], n: Column) -> Column:
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(n == i, options[i]).otherwise(out)
    return out


def corrupt(clean: DataFrame, domain: str, seed: int, dates: str = "mixed_us", tokens: float = 0.06, padded: float = 0.05, garbage: float = 0.004, rename: bool = True, units: float = 0.0) -> Messy:
    """The clean rows as a raw table of text; the rates are of cells.

    units is the share of weights and lengths that are in another unit, which no rule of the planner turns back.
    """
    spec = DOMAINS[domain]
    dirty, marks, injected = [], [], set()
    renames = {c: s for c, (*_, s) in spec.items() if s and rename}
    issue = {"int": "mixed_types", "float": "mixed_types", "money": "mixed_types", "date": "date_formats", "datetime": "date_as_text", "bool": "bool_as_text", "category": "inconsistent_categories"}
    for c, (kind, *_) in spec.items():
        v = F.col(c)
        styled = _styled(c, kind, v, seed, dates)
        other = next((u for ending, u in UNITS.items() if c.endswith(ending)), None)
        if other and units:
            styled = F.when(_share(seed, c + "unit") < units, F.concat((v * other[1]).cast("decimal(18,2)").cast("string"), F.lit(f" {other[0]}"))).otherwise(styled)
        junk = (_share(seed, c + "junk") < garbage) if kind in ("int", "float", "money", "date", "datetime") else F.lit(False)
        token = (_share(seed, c + "token") < tokens) if kind not in ("id", "name") else F.lit(False)
        pad = (_share(seed, c + "pad") < padded) if kind != "id" else F.lit(False)
        token_text = _pick(TOKENS, _number(seed, c + "which", len(TOKENS)))
        text = F.when(junk, F.lit("see notes")).when(token | v.isNull(), F.when(token, token_text)).when(pad, F.concat(F.lit("  "), styled, F.lit("\t"))).otherwise(styled)
        name = renames.get(c, c)
        dirty.append(text.alias(name))
        changed = ~text.eqNullSafe(_as_text(kind, v))
        marks.append(F.when(junk, F.lit("garbage")).when(token, F.lit("null_token")).when(changed, F.lit("style")).alias(c))
        if kind in issue and not (kind == "date" and dates == "iso"):
            injected.add((name, issue[kind]))
        if kind not in ("id", "name"):
            injected.add((name, "null_tokens"))
        if kind != "id":
            injected.add((name, "whitespace"))
        if not t.is_snake(name):
            injected.add((name, "naming"))
    return Messy(domain, clean, clean.select("_rid", *dirty), clean.select("_rid", *marks), renames, injected)


def shaped(df: DataFrame, column: str, seed: int, rate: float = 0.1) -> DataFrame:
    """df as JSON documents, column doc, in which a share of the column's values stand inside an object."""
    fields = [t.column(c) for c in df.columns if c not in ("_rid", column)]
    inside, plain = F.struct(t.column(column).alias("value")).alias(column), t.column(column)
    return df.select(F.when(_share(seed, column + "shape") < rate, F.to_json(F.struct(*fields, inside))).otherwise(F.to_json(F.struct(*fields, plain))).alias("doc"))


def target_schema(domain: str) -> dict[str, dict]:
    return {c: {"type": TYPES[kind]} for c, (kind, *_) in DOMAINS[domain].items()}

"""A deterministic synthetic parts catalogue, driven by a column of integer ids.

Every value is a Murmur3 draw (Spark's ``hash``) on the id and a salt, so rows are
generated where their id lives: no shuffle, no order, the same row on every run.
"""

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from itemweld.operators.features import is_base_part
from itemweld.operators.ranking import with_percent_rank
from itemweld.schema import ATTRIBUTES, INTEGER_ATTRIBUTES, conform
from itemweld.sources.staging import Stages

# --- Fixed values: they define the published catalogue -------------------------
PLANTS = [
    ("HV0", "North Harvester Works", "Northern Region", "harvester"),
    ("HV1", "South Harvester Works", "Southern Region", "harvester"),
    ("TR0", "East Tractor Works", "Eastern Region", "tractor"),
    ("TR1", "West Tractor Works", "Western Region", "tractor"),
]
MACHINE_OF_FOCUS = {"harvester": "Harvester", "tractor": "Tractor"}
MODEL_SERIES = ["Field", "Ranger", "Pro", "Max"]

SUPPLIER_COUNT = 200
PART_DIGITS, PART_NUMBERS = 7, 20_000   # least width of a part id; the published modulus of part numbers
SUPPLIER_REGIONS = ["North", "South", "East", "West", "Central"]

CATEGORIES = [
    "Bolt", "Pin/Shaft", "Hose", "Bushing/Bearing", "Gasket", "Bracket/Plate",
    "Wire/Cable", "Seal/O-ring",
]
NUMBER_PREFIX = ["BLT", "PIN", "HOS", "BSH", "GSK", "BRK", "WIR", "SEL"]
MATERIALS = {
    "Bolt": ["Steel", "Stainless Steel", "Alloy Steel", "Titanium"],
    "Pin/Shaft": ["Steel", "Alloy Steel", "Titanium"],
    "Hose": ["Rubber", "PTFE", "Nylon"],
    "Bushing/Bearing": ["Bronze", "Steel", "Brass"],
    "Gasket": ["Rubber", "Cork", "Graphite", "PTFE"],
    "Bracket/Plate": ["Steel", "Stainless Steel", "Aluminum"],
    "Wire/Cable": ["Copper", "Aluminum"],
    "Seal/O-ring": ["Nitrile", "Viton", "Silicone"],
}
DENSITY = {
    "Steel": "7.85", "Stainless Steel": "8.0", "Alloy Steel": "7.85", "Titanium": "4.5",
    "Rubber": "1.2", "PTFE": "2.2", "Nylon": "1.15", "Bronze": "8.8", "Brass": "8.5",
    "Cork": "0.24", "Graphite": "1.8", "Aluminum": "2.7", "Copper": "8.96",
    "Nitrile": "1.0", "Viton": "1.8", "Silicone": "1.1", "Silver": "10.49", "Inconel": "8.44",
}
# attribute: (low, high, decimals); "_wall" is the outer minus the inner diameter
CONTINUOUS = {
    "Bolt": {"nominal_diameter": ("5", "24", 1), "length": ("15", "120", 1),
             "thread_pitch": ("0.8", "3.0", 2), "tensile_strength": ("350", "1300", 0)},
    "Pin/Shaft": {"diameter": ("4", "28", 1), "length": ("25", "220", 1), "hardness": ("25", "62", 0)},
    "Hose": {"inner_diameter": ("5", "35", 1), "_wall": ("3", "8", 1),
             "length": ("400", "3200", 0), "pressure_rating": ("40", "360", 0)},
    "Bushing/Bearing": {"inner_diameter": ("8", "45", 1), "_wall": ("6", "18", 1),
                        "width": ("6", "20", 1), "load_rating": ("4", "45", 1)},
    "Gasket": {"inner_diameter": ("18", "110", 1), "_wall": ("8", "35", 1),
               "thickness": ("0.8", "3.5", 2), "temperature_rating": ("100", "420", 0)},
    "Bracket/Plate": {"length": ("45", "220", 1), "width": ("25", "110", 1), "thickness": ("2.5", "11", 1)},
    "Wire/Cable": {"length": ("800", "11000", 0), "gauge": ("0.4", "4.5", 2),
                   "voltage_rating": ("250", "1100", 0)},
    "Seal/O-ring": {"inner_diameter": ("4", "45", 1), "cross_section_diameter": ("1.2", "4.0", 2),
                    "hardness": ("55", "95", 0)},
}
WHOLE = {"Bracket/Plate": {"hole_count": (2, 8)}, "Wire/Cable": {"conductor_count": (1, 5)}}

# The functional value a hard negative changes: attribute, operation, amount, decimals
HARD_NEGATIVE = {
    "Bolt": ("thread_pitch", "times", "1.6", 3),
    "Pin/Shaft": ("hardness", "times", "1.4", 1),
    "Hose": ("pressure_rating", "times", "1.5", 1),
    "Bushing/Bearing": ("load_rating", "times", "1.5", 1),
    "Gasket": ("temperature_rating", "times", "1.5", 1),
    "Bracket/Plate": ("hole_count", "plus", "2", None),
    "Wire/Cable": ("voltage_rating", "times", "2", None),
    "Seal/O-ring": ("hardness", "times", "1.4", 1),
}
NEAR_MISS_MATERIAL = {
    "Bolt": "Brass", "Pin/Shaft": "Brass", "Hose": "Silicone", "Bushing/Bearing": "Nylon",
    "Gasket": "Steel", "Bracket/Plate": "Brass", "Wire/Cable": "Silver", "Seal/O-ring": "PTFE",
}
LABEL_OF_SUFFIX = {"D": "duplicate", "H": "hard_negative", "N": "near_miss"}
DUPLICATE_ONE_IN, HARD_NEGATIVE_ONE_IN, NEAR_MISS_ONE_IN = 20, 50, 100

# description pieces: text, or (attribute, "int" | "num")
DESCRIPTION = {
    "Bolt": ["M", ("nominal_diameter", "num"), " x ", ("length", "int"), " mm, pitch ",
             ("thread_pitch", "num"), " mm, ", ("tensile_strength", "int"), " MPa"],
    "Pin/Shaft": ["dia ", ("diameter", "num"), " x ", ("length", "int"), " mm, ", ("hardness", "int"), " HRC"],
    "Hose": ["ID ", ("inner_diameter", "num"), " / OD ", ("outer_diameter", "num"), " x ",
             ("length", "int"), " mm, ", ("pressure_rating", "int"), " bar"],
    "Bushing/Bearing": ["ID ", ("inner_diameter", "num"), " / OD ", ("outer_diameter", "num"), " x ",
                        ("width", "num"), " mm, ", ("load_rating", "int"), " kN"],
    "Gasket": ["ID ", ("inner_diameter", "num"), " / OD ", ("outer_diameter", "num"), " x ",
               ("thickness", "raw"), " mm, ", ("temperature_rating", "int"), " C"],
    "Bracket/Plate": [("length", "num"), " x ", ("width", "num"), " x ", ("thickness", "raw"), " mm, ",
                      ("hole_count", "raw"), " holes"],
    "Wire/Cable": [("gauge", "raw"), " mm2 x ", ("length", "int"), " mm, ", ("voltage_rating", "int"),
                   " V, ", ("conductor_count", "raw"), " cond"],
    "Seal/O-ring": ["ID ", ("inner_diameter", "num"), " x CS ", ("cross_section_diameter", "raw"),
                    " mm, ", ("hardness", "int"), " Shore A"],
}
VOLUME_LOW = {"Bolt": 20, "Seal/O-ring": 20, "Gasket": 10}
VOLUME_LOW_ELSE = 5
VOLUME_RATIO = {"Bolt": 100.0, "Seal/O-ring": 100.0, "Gasket": 60.0}
VOLUME_RATIO_ELSE = 80.0

PRICE_LOW = {
    "Bolt": 0.30, "Pin/Shaft": 4.0, "Hose": 18.0, "Bushing/Bearing": 6.0, "Gasket": 2.5,
    "Bracket/Plate": 12.0, "Wire/Cable": 8.0, "Seal/O-ring": 0.60,
}
PRICE_RATIO = {
    "Bolt": 30.0, "Pin/Shaft": 40.0, "Hose": 14.0, "Bushing/Bearing": 53.0, "Gasket": 34.0,
    "Bracket/Plate": 35.0, "Wire/Cable": 42.0, "Seal/O-ring": 47.0,
}
PRICE_OF_MATERIAL = {
    "Titanium": 4.0, "Stainless Steel": 1.6, "Alloy Steel": 1.3, "Bronze": 1.5, "Brass": 1.4,
    "PTFE": 2.2, "Viton": 2.5, "Silicone": 1.6, "Graphite": 1.8, "Silver": 6.0,
    "Aluminum": 0.9, "Nylon": 0.9, "Cork": 0.8,
}
LEAD_TIMES = [7, 14, 21, 30, 45, 60]
GRADES = ["A", "B", "C"]
# ----------------------------------------------------------------------------


def draw(n: int, *salted) -> Column:
    """A number in 0..n-1 from the hash of a column and salts."""
    return F.pmod(F.hash(*[c if isinstance(c, Column) else F.lit(c) for c in salted]), F.lit(n))


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def choose(column: Column, table: dict, otherwise=None) -> Column:
    """CASE over a fixed table."""
    out = F
    for key, value in table.items():
        out = out.when(column == key, value if isinstance(value, Column) else F.lit(value))
    return out if otherwise is None else out.otherwise(otherwise)


def plants(spark: SparkSession) -> DataFrame:
    return conform(spark.createDataFrame(
        PLANTS, "plant_id string, plant_name string, location string, machine_focus string"), "plants")


def model_names(series=MODEL_SERIES):
    return [f"{plant[0]}_M{n:03d}" for plant in PLANTS for n in range(1, len(series) + 1)]


def models(plant_table: DataFrame) -> DataFrame:
    """Each plant builds one model per series."""
    named = F.posexplode(F.array(*[F.lit(s) for s in MODEL_SERIES])).alias("i", "series")
    machine = choose(F.col("machine_focus"), MACHINE_OF_FOCUS)
    n = F.col("i") + 1
    return conform(plant_table.select("plant_id", "machine_focus", named).select(
        F.concat("plant_id", F.lit("_M"), F.lpad(n.cast("string"), 3, "0")).alias("model_id"),
        "plant_id", machine.alias("machine_type"),
        F.concat(machine, F.lit(" "), "series", F.lit(" v"), (n % 3 + 1).cast("string")).alias("model_name")),
        "models")


def suppliers(ids: DataFrame) -> DataFrame:
    """One supplier per id; ``spark.range(SUPPLIER_COUNT)`` gives the published ones."""
    name = F.col("id").cast("string")
    return conform(ids.select(
        F.concat(F.lit("S"), F.lpad(name, F.greatest(F.lit(3), F.length(name)), F.lit("0"))).alias("supplier_id"),
        F.concat(F.lit("Supplier "), name).alias("supplier_name"),
        pick(SUPPLIER_REGIONS, F.pmod("id", F.lit(len(SUPPLIER_REGIONS)))).alias("region")), "suppliers")


def _continuous(number: int, attribute: str, low: str, high: str, decimals: int) -> Column:
    low, high = Decimal(low), Decimal(high)
    share = draw(100_000, F.col("id"), f"{number}_{attribute}") / F.lit(Decimal("100000.0"))
    return F.round(F.lit(low) + share * F.lit(high - low), decimals)


def base_parts(ids: DataFrame, round_once=False) -> DataFrame:
    """Base parts, all arithmetic decimal until the final cast to the schema.

    The published catalogue rounds a weight twice, since Spark cuts a decimal quotient to six digits;
    with ``round_once`` no digit is lost before the one rounding.
    """
    id_ = F.col("id")
    category = pick(CATEGORIES, F.pmod(id_, F.lit(len(CATEGORIES))))
    out = ids.select("id").withColumn("part_category", category)
    kind = F.col("part_category")
    attributes = {}
    for number, name in enumerate(CATEGORIES):
        for attribute, spec in CONTINUOUS[name].items():
            attributes.setdefault(attribute, {})[name] = _continuous(number, attribute, *spec)
        for attribute, (low, high) in WHOLE.get(name, {}).items():
            attributes.setdefault(attribute, {})[name] = (
                F.lit(low) + draw(high - low + 1, id_, f"{number}_{attribute}"))
    out = out.withColumns({a: choose(kind, cases) for a, cases in attributes.items()})
    out = out.withColumns({
        "outer_diameter": F.round(F.col("inner_diameter") + F.col("_wall"), 1),
        "head_width": F.round(F.col("nominal_diameter") * F.lit(Decimal("1.6")), 2),
        "material": choose(kind, {c: pick(m, draw(len(m), id_, 3)) for c, m in MATERIALS.items()}),
    })
    out = out.withColumn("material_density", choose(
        F.col("material"), {m: Decimal(d) for m, d in DENSITY.items()}, F.lit(Decimal("5.0"))))
    long_side = F.greatest(F.coalesce("length", "outer_diameter", "diameter", "inner_diameter",
                                      F.lit(Decimal("10.0"))), F.lit(Decimal("1.0")))
    short_side = F.greatest(F.coalesce("width", "thickness", "cross_section_diameter", "gauge", "head_width",
                                       F.lit(Decimal("5.0"))), F.lit(Decimal("1.0")))
    if round_once:
        mass = F.lit(Decimal("0.001")) * F.col("material_density").cast("decimal(4,2)")
        for side in (long_side, short_side):
            mass = mass * side.cast("decimal(12,2)")
    else:
        mass = F.col("material_density") * long_side * short_side / F.lit(Decimal("1000.0"))
    names, number = model_names(), id_.cast("string")
    return conform(out.select(
        F.concat(F.lit("P"), F.lpad(number, F.greatest(F.lit(PART_DIGITS), F.length(number)), F.lit("0"))).alias("part_id"),
        pick(names, draw(len(names), id_, 201)).alias("model_id"),
        F.concat(pick(NUMBER_PREFIX, F.pmod(id_, F.lit(len(CATEGORIES)))), F.lit("-"),
                 F.lpad(F.pmod(id_, F.lit(PART_NUMBERS)).cast("string"), 5, "0")).alias("part_number"),
        "part_category", "material", "material_density",
        F.round(mass, 3).alias("weight"),
        *[c for c in ATTRIBUTES if c in out.columns]), "parts")


def _variant(rows: DataFrame, suffix: str, changed: dict) -> DataFrame:
    return conform(rows.withColumns({
        **changed,
        "part_number": F.concat("part_number", F.lit(suffix)),
    }).withColumn("part_id", F.concat("part_id", F.lit("-" + suffix))), "parts")


def duplicates(parts: DataFrame) -> DataFrame:
    """One base part in twenty again, in another model, each measure within 1 %."""
    part_id, names = F.col("part_id"), model_names()
    rows = parts.where(is_base_part() & (draw(DUPLICATE_ONE_IN, part_id) == 0))
    at = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("model_id"))   # 1-based
    moved = F.pmod(at + draw(len(names) - 1, part_id, "vm"), F.lit(len(names)))

    def jitter(column):
        step = (draw(41, part_id, f"j_{column}") - 20) / F.lit(Decimal("2000.0"))
        return F.round(F.col(column) * (1 + step), 3)

    measures = ["weight"] + [a for a in ATTRIBUTES if a not in INTEGER_ATTRIBUTES]
    return _variant(rows, "D", {"model_id": pick(names, moved), **{m: jitter(m) for m in measures}})


def hard_negatives(parts: DataFrame) -> DataFrame:
    """The same geometry with one functional value changed."""
    rows = parts.where(is_base_part() & (draw(HARD_NEGATIVE_ONE_IN, F.col("part_id"), "hn") == 0))
    changed = {}
    for category, (attribute, operation, amount, decimals) in HARD_NEGATIVE.items():
        now = F.col(attribute)
        new = now + int(amount) if operation == "plus" else now * F.lit(Decimal(amount))
        if decimals is not None:
            new = F.round(new, decimals)
        changed[attribute] = F.when(F.col("part_category") == category, new).otherwise(changed.get(attribute, now))
    return _variant(rows, "H", changed)


def near_misses(parts: DataFrame) -> DataFrame:
    """The same geometry in another material."""
    rows = parts.where(is_base_part() & (draw(NEAR_MISS_ONE_IN, F.col("part_id"), "nm") == 0))
    kind = F.col("part_category")
    return _variant(rows, "N", {
        "material": choose(kind, NEAR_MISS_MATERIAL),
        "material_density": choose(kind, {c: float(DENSITY[m]) for c, m in NEAR_MISS_MATERIAL.items()})})


def with_description(parts: DataFrame) -> DataFrame:
    def text(piece):
        if isinstance(piece, str):
            return F.lit(piece)
        column, how = F.col(piece[0]), piece[1]
        if how == "int":
            column = column.cast("int")
        elif how == "num":
            column = F.round(column, 1)
        return column.cast("string")

    body = choose(F.col("part_category"), {
        category: F.concat(*[text(p) for p in pieces]) for category, pieces in DESCRIPTION.items()})
    return parts.withColumn("description", F.concat_ws(
        ", ", F.concat_ws(" ", "material", "part_category"), body, F.concat(F.lit("PN "), "part_number")))


def with_annual_volume(parts: DataFrame) -> DataFrame:
    """Log-uniform volume inside the category's range."""
    kind = F.col("part_category")
    share = draw(100_000, F.col("part_id"), "vol").cast("double") / 100_000
    low = choose(kind, VOLUME_LOW, F.lit(VOLUME_LOW_ELSE))
    ratio = choose(kind, VOLUME_RATIO, F.lit(VOLUME_RATIO_ELSE))
    return parts.withColumn("annual_volume", F.round(low * F.pow(ratio, share)).cast("int"))


def with_seeds(base: DataFrame) -> DataFrame:
    """Stored base parts and all variants seeded from them, described and with volumes."""
    every = reduce(DataFrame.unionByName, [base, duplicates(base), hard_negatives(base), near_misses(base)])
    return with_annual_volume(with_description(every))


def parts(ids: DataFrame, stages: Stages, round_once=False) -> DataFrame:
    """Base parts and all seeded variants."""
    return with_seeds(stages.save(base_parts(ids, round_once), "base_parts"))


def offers(part_table: DataFrame, stages: Stages) -> DataFrame:
    """One to three offers per part around a list price that follows its size."""
    sized = with_percent_rank(part_table.select("part_id", "part_category", "material", "weight"),
                              "part_category", "weight", "size_pct", stages)
    kind, part_id = F.col("part_category"), F.col("part_id")
    listed = sized.withColumn(
        "list_price", choose(kind, PRICE_LOW) * F.pow(choose(kind, PRICE_RATIO), F.col("size_pct"))
        * choose(F.col("material"), PRICE_OF_MATERIAL, F.lit(1.0)))
    n = listed.withColumn("oi", F.explode(F.sequence(F.lit(0), draw(3, part_id))))
    oi = F.col("oi")
    return conform(n.select(
        F.concat(F.lit("S"), F.lpad(draw(SUPPLIER_COUNT, part_id, oi).cast("string"), 3, "0")).alias("supplier_id"),
        "part_id",
        F.round(F.col("list_price") * (F.lit(Decimal("0.80")) + draw(41, part_id, oi, "p") / F.lit(Decimal("100.0"))), 2)
         .alias("price_per_unit"),
        F.round(draw(15, part_id, oi, "d") / F.lit(Decimal("100.0")), 2).alias("unit_discount"),
        pick(LEAD_TIMES, draw(len(LEAD_TIMES), part_id, oi, "l")).alias("lead_time_days"),
        F.lit("USD").alias("currency"),
        pick(GRADES, draw(len(GRADES), part_id, oi, "q")).alias("material_quality_grade")), "supplier_catalogs")

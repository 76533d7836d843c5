"""The step grammar: `Charge at C/10 until 4.1 V or for 1 hour` as columns, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import mapped

#: Unit -> quantity, canonical unit, factor.
UNITS = {
    "a": ("current", "A", 1.0), "ma": ("current", "A", 1e-3), "c": ("c_rate", "A/Ah", 1.0), "w": ("power", "W", 1.0), "mw": ("power", "W", 1e-3),
    "v": ("voltage", "V", 1.0), "mv": ("voltage", "V", 1e-3), "ohm": ("resistance", "Ohm", 1.0), "ohms": ("resistance", "Ohm", 1.0), "ω": ("resistance", "Ohm", 1.0),
}
#: Time unit -> seconds.
SECONDS = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "m": 60.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0, "hours": 3600.0}
#: The control mode of an operation at a value of some quantity.
MODES = {
    "charge": {"current": "cc", "c_rate": "cc", "power": "cp", "resistance": "cr", "voltage": "cv"},
    "discharge": {"current": "cc", "c_rate": "cc", "power": "cp", "resistance": "cr", "voltage": "cv"},
    "hold": {"voltage": "cv"},
}
CONTROLLED = {"cc": "current", "cv": "voltage", "cccv": "current", "cp": "power", "cr": "resistance"}


def let(c: Column, body) -> Column:
    """body(c), with c evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(c), lambda x: body(x)), 1)


def amount(written: Column) -> Column:
    """struct<number, unit> of a number written before its unit, with or without a space; in small letters."""
    dense = F.replace(F.lower(written), F.lit(" "), F.lit(""))
    digits = F.regexp_substr(dense, F.lit(r"^[0-9.]+"))
    return F.struct(digits.try_cast("double").alias("number"), F.substr(dense, F.length(digits) + 1).alias("unit"))


def quantity(written: Column) -> Column:
    """struct<kind, value, unit> of `C/10`, `1C`, `200 mA`, `4.1 V`; null where it is none."""
    made = lambda k, v, u: F.struct(k.alias("kind"), v.alias("value"), u.alias("unit"))

    def of(p: Column) -> Column:
        head, a = F.replace(F.element_at(p["sides"], 1), F.lit(" "), F.lit("")), p["whole"]
        divisor = F.when((F.size(p["sides"]) == 2) & head.isin("c", "d"), F.trim(F.element_at(p["sides"], -1)).try_cast("double"))
        kind, canonical, factor = (mapped(a["unit"], {u: row[i] for u, row in UNITS.items()}) for i in range(3))
        return F.when(divisor != 0, made(F.lit("c_rate"), 1 / divisor, F.lit("A/Ah"))).when(kind.isNotNull() & a["number"].isNotNull(), made(kind, a["number"] * factor, canonical))

    return let(F.struct(F.split(F.trim(F.lower(written)), "/").alias("sides"), amount(written).alias("whole")), of)


def seconds(written: Column) -> Column:
    return let(amount(written), lambda a: a["number"] * mapped(a["unit"], SECONDS))


def step(c: Column) -> Column:
    """struct<mode, direction, setpoint, duration_s, termination: array, problem>; problem says why a text is no step.

    The text is cut before its words `for`, `until` and `or`. The first piece is the operation and, after `at`, its value; each
    piece after it is a duration or an end.
    """
    word = lambda w: F.when(w.isin("for", "until"), F.concat(F.lit("\n"), w)).when(w == "or", "\n").otherwise(w)
    pieces = F.filter(F.transform(F.split(F.array_join(F.transform(F.split(F.trim(F.lower(c)), r"\s+"), word), " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def read(p: Column) -> Column:
        first = F.split(F.try_element_at(p, F.lit(1)), " ")
        op = F.when(first[0].isin("charge", "discharge", "hold", "rest"), first[0])
        given = F.array_join(F.slice(first, 3, F.greatest(F.size(first) - 2, F.lit(0))), " ")
        clauses = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        after = lambda w: F.transform(F.filter(clauses, lambda x: x.startswith(w)), lambda x: F.substr(x, F.lit(len(w) + 1)))
        lasting, ending = after("for "), after("until ")
        resting = op == "rest"
        return F.struct(
            op.alias("op"), (resting | F.coalesce(F.try_element_at(first, F.lit(2)) == "at", F.lit(False))).alias("valued"), F.when(~resting, quantity(given)).alias("setpoint"),
            lasting.alias("lasting"), ending.alias("ending"), ((F.size(lasting) + F.size(ending) < F.size(clauses)) | resting & (F.size(first) > 1)).alias("odd"),
        )

    def judged(r: Column) -> Column:
        end = lambda q: F.struct(
            q["kind"].alias("quantity"), q["value"].alias("value"), q["unit"].alias("unit"), F.when((q["kind"] == "voltage") & (r["op"] == "charge"), "above").otherwise("below").alias("direction")
        )
        modes = {f"{op} {kind}": mode for op, kinds in MODES.items() for kind, mode in kinds.items()}
        return F.struct(
            r["op"].alias("op"), r["valued"].alias("valued"), r["odd"].alias("odd"), F.when(r["op"] == "rest", "rest").otherwise(mapped(F.concat_ws(" ", r["op"], r["setpoint"]["kind"]), modes)).alias("mode"),
            r["op"].alias("direction"), r["setpoint"].alias("setpoint"), seconds(F.try_element_at(r["lasting"], F.lit(-1))).alias("duration_s"), (F.size(r["lasting"]) > 0).alias("lasts"),
            F.transform(r["ending"], lambda x: let(quantity(x), end)).alias("termination"),
        )

    def checked(r: Column) -> Column:
        bad_end = F.exists(r["termination"], lambda e: e["quantity"].isNull() | ~e["quantity"].isin("voltage", "current", "c_rate"))
        problem = (
            F.when(r["op"].isNull(), "no operation").when(~r["valued"], "no value").when((r["op"] != "rest") & r["setpoint"].isNull(), "bad value").when(r["mode"].isNull(), "wrong quantity")
            .when(r["odd"], "bad clause").when(r["lasts"] & r["duration_s"].isNull(), "bad duration").when(bad_end, "bad end")
        )
        return F.struct(*[r[n].alias(n) for n in ("mode", "direction", "setpoint", "duration_s", "termination")], problem.alias("problem"))

    return let(let(let(pieces, read), judged), checked)


def number_text(c: Column) -> Column:
    """A number as short as it goes: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", c), "0+$", ""), r"\.$", "")


def rendered(s: Column) -> Column:
    """A step as text again (the forms that `step` reads)."""
    return let(s, _rendered)


def _rendered(s: Column) -> Column:
    suffix = {"current": " A", "c_rate": "C", "power": " W", "voltage": " V", "resistance": " Ohm"}
    head = F.when(s["mode"] == "rest", "Rest").otherwise(
        F.concat(F.initcap(s["direction"]), F.lit(" at "), number_text(s["setpoint"]["value"]), mapped(s["setpoint"]["kind"], suffix))
    )
    lasting = F.when(s["duration_s"].isNotNull(), F.concat(F.lit("for "), number_text(s["duration_s"]), F.lit(" seconds")))
    ends = F.transform(s["termination"], lambda e: F.concat(F.lit("until "), number_text(e["value"]), mapped(e["quantity"], suffix)))
    clauses = F.array_join(F.array_compact(F.concat(F.array(lasting), ends)), " or ")
    return F.when(clauses != "", F.concat_ws(" ", head, clauses)).otherwise(head)


def facets(method: Column) -> Column:
    """Facets of an array of steps (struct as `step` makes it): what queries filter by."""
    return let(method, _facets)


def _facets(method: Column) -> Column:
    distinct = lambda f: F.array_sort(F.array_distinct(F.array_compact(F.transform(method, f))))
    of = lambda kind: F.concat(
        F.array_compact(F.transform(method, lambda s: F.when(s["setpoint"]["kind"] == kind, s["setpoint"]["value"]))),
        F.flatten(F.transform(method, lambda s: F.transform(F.filter(s["termination"], lambda e: e["quantity"] == kind), lambda e: e["value"]))),
    )
    modes = F.array_distinct(F.transform(method, lambda s: s["mode"]))
    voltages = of("voltage")
    return F.struct(
        modes.alias("modes"), distinct(lambda s: F.when(~s["direction"].isin("rest", "hold"), s["direction"])).alias("directions"), distinct(lambda s: mapped(s["mode"], CONTROLLED)).alias("control_modes"),
        F.arrays_overlap(modes, F.array(F.lit("cv"), F.lit("cccv"))).alias("has_cv_hold"), F.array_contains(modes, "rest").alias("has_rest"), F.array_contains(modes, "eis").alias("has_eis"),
        F.array_sort(F.array_distinct(of("c_rate"))).alias("c_rates"), F.when(F.size(voltages) > 0, F.array(F.array_min(voltages), F.array_max(voltages))).alias("voltage_window"),
    )

"""Cell and device dimensions, process constants and the delay formulas over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Cell, intrinsic delay ns, input cap fF, output resistance ohm, drive strength, pins, function.
CELLS = [
    ("INV_X1", 0.017, 0.98, 320.0, 1.0, 1, "NOT"),
    ("INV_X2", 0.014, 1.96, 160.0, 2.0, 1, "NOT"),
    ("BUF_X1", 0.032, 0.98, 320.0, 1.0, 1, "BUF"),
    ("BUF_X2", 0.027, 1.96, 160.0, 2.0, 1, "BUF"),
    ("NAND2_X1", 0.024, 1.05, 350.0, 1.0, 2, "NAND"),
    ("NAND2_X2", 0.02, 2.1, 175.0, 2.0, 2, "NAND"),
    ("NAND3_X1", 0.031, 1.05, 420.0, 1.0, 3, "NAND"),
    ("NOR2_X1", 0.028, 1.1, 380.0, 1.0, 2, "NOR"),
    ("NOR2_X2", 0.023, 2.2, 190.0, 2.0, 2, "NOR"),
    ("NOR3_X1", 0.038, 1.1, 460.0, 1.0, 3, "NOR"),
    ("AND2_X1", 0.038, 1.05, 320.0, 1.0, 2, "AND"),
    ("AND2_X2", 0.032, 2.1, 160.0, 2.0, 2, "AND"),
    ("OR2_X1", 0.042, 1.1, 320.0, 1.0, 2, "OR"),
    ("OR2_X2", 0.036, 2.2, 160.0, 2.0, 2, "OR"),
    ("XOR2_X1", 0.055, 1.5, 400.0, 1.0, 2, "XOR"),
    ("XNOR2_X1", 0.055, 1.5, 400.0, 1.0, 2, "XNOR"),
    ("MUX2_X1", 0.048, 1.3, 360.0, 1.0, 3, "MUX"),
    ("AOI21_X1", 0.03, 1.05, 370.0, 1.0, 3, "AOI"),
    ("OAI21_X1", 0.032, 1.1, 380.0, 1.0, 3, "OAI"),
]
# Device, W m, L m, Cgs F, Cgd F, gm, input cap F, operating region; None where a class has no such parameter.
DEVICES = [
    ("NMOS", 2e-6, 130e-9, 1.0e-15, 0.2e-15, 1e-3, 1.2e-15, 1.0),
    ("PMOS", 5e-6, 130e-9, 2.5e-15, 0.4e-15, 0.7e-3, 2.9e-15, 1.0),
    ("R", None, None, None, None, None, 0.05e-15, 0.0),
    ("C", None, None, None, None, None, 100e-15, 0.0),
    ("CURRENT_MIRROR", None, None, None, None, None, 1.5e-15, -1.0),
    ("DIFF_PAIR", None, None, None, None, None, 1.8e-15, -1.0),
]
# Wire and pin constants, thresholds, process constants, feature scales.
WIRE_CAP, WIRE_RES, UNLOADED_UM, PO_CAP = 0.00017, 0.12, 2.0, 2.0
CRITICAL_NS, DRC_DEMAND = 0.05, 9.0
COX, MU_N, MU_P, LAMBDA_N, LAMBDA_P, BIAS_A = 6e-3, 300e-4, 100e-4, 0.1, 0.15, 50e-6
DELAY_REF, CAP_REF, RES_REF, CLOCK_REF, WIRE_REF, MANHATTAN_REF, FANOUT_REF, COUPLING_REF = 0.1, 5.0, 500.0, 2.0, 0.1, 30.0, 10.0, 1e-15


def cells(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CELLS)]
    return spark.createDataFrame(rows, "cell_idx long, cell string, intrinsic_delay double, input_cap double, output_res double, drive_strength double, num_inputs long, function string")


def devices(spark: SparkSession) -> DataFrame:
    rows = [(i, *d) for i, d in enumerate(DEVICES)]
    return spark.createDataFrame(rows, "dev_idx long, device string, w double, l double, cgs double, cgd double, gm double, input_cap double, region double")


def wire_delay(length: Column, cap: Column) -> Column:
    """Elmore delay in ns of a wire with a pin of that capacitance at its end."""
    return WIRE_RES * length * (WIRE_CAP * length / 2.0 + cap) * 1e-3


def gate_delay(intrinsic: Column, resistance: Column, load: Column) -> Column:
    return intrinsic + resistance * load * 1e-6


def estimate_gm(mobility: Column, w: Column, length: Column, bias: Column) -> Column:
    return F.sqrt(2.0 * mobility * COX * (w / F.greatest(length, F.lit(1e-12))) * F.greatest(bias, F.lit(1e-9)))


def estimate_cgs(w: Column, length: Column) -> Column:
    return (2.0 / 3.0) * COX * w * length


def device_cap() -> Column:
    """A device's own capacitance: its Cgs if that is neither null nor 0, else the estimate from width and length, else the input
    capacitance of a device that has no gate."""
    return F.coalesce(F.nullif("cgs", F.lit(0.0)), estimate_cgs(F.col("w"), F.col("l")), "input_cap")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def pseudo_logit(y: Column, scale: float = 10.0) -> Column:
    return (y - 0.5) * scale


def sql_values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list; floats as doubles."""

    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


CELLS_SQL = f"(SELECT * FROM (VALUES {sql_values([(i, *c) for i, c in enumerate(CELLS)])}) AS t(cell_idx, cell, intrinsic_delay, input_cap, output_res, drive_strength, num_inputs, function))"
DEVICES_SQL = f"(SELECT * FROM (VALUES {sql_values([(i, *d) for i, d in enumerate(DEVICES)])}) AS t(dev_idx, device, w, l, cgs, cgd, gm, input_cap, region))"

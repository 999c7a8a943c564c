"""Parsed statements to cells, wires and circuits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import udtf

# Functions that one library cell covers, by number of inputs.
DIRECT = {("NAND", 2): "NAND2_X1", ("NAND", 3): "NAND3_X1", ("NOR", 2): "NOR2_X1", ("NOR", 3): "NOR3_X1", ("AND", 2): "AND2_X1", ("OR", 2): "OR2_X1", ("XOR", 2): "XOR2_X1", ("XNOR", 2): "XNOR2_X1"}


def _base(func: Column) -> Column:
    return F.when(func.isin("OR", "NOR"), "OR2_X1").when(func.isin("XOR", "XNOR"), "XOR2_X1").otherwise("AND2_X1")


def decompose(gates: DataFrame) -> DataFrame:
    """(name, gate, cell_no, cell, out, ins) for each gate: one cell where the library has it, else a balanced tree of
    two-input cells, and an inverter after it for NAND, NOR and XNOR. Rounds pair neighbours; an odd one passes on."""
    func, k = F.upper("func"), F.size("ins")
    direct = F.when(func.isin("NOT", "INV"), "INV_X1").when(func.isin("BUF", "BUFF", "BUFFER") | (k == 1), "BUF_X1")
    for (f, n), cell in DIRECT.items():
        direct = direct.when((func == f) & (k == n), cell)
    g = gates.where("kind = 'gate'").withColumns({"direct": direct, "invert": func.isin("NAND", "NOR", "XNOR"), "base": _base(func)})
    single = func.isin("NOT", "INV", "BUF", "BUFF", "BUFFER")
    one = g.where("direct IS NOT NULL").select("name", "seq", F.col("out").alias("gate"), F.lit(0).alias("cell_no"), F.col("direct").alias("cell"), "out", F.when(single, F.slice("ins", 1, 1)).otherwise(F.col("ins")).alias("ins"))
    start = F.struct(F.col("ins").alias("level"), F.array().cast("array<struct<out:string,ins:array<string>>>").alias("cells"))

    def pair(acc: Column, r: Column) -> Column:
        level, n = acc["level"], F.size(acc["level"])
        name = lambda i: F.concat_ws("_", F.lit("w"), "out", r.cast("string"), i.cast("string"))
        half = F.floor(n / 2).cast("int")
        new = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(name(i).alias("out"), F.slice(level, 2 * i + 1, 2).alias("ins")))
        passed = F.when(n % 2 == 1, F.slice(level, n, 1)).otherwise(F.array().cast("array<string>"))
        done = F.struct(F.concat(F.transform(new, lambda c: c["out"]), passed).alias("level"), F.concat(acc["cells"], new).alias("cells"))
        return F.when(n > 2, done).otherwise(acc)

    wide = g.where("direct IS NULL").withColumn("t", F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size("ins"))).cast("int")), start, pair))
    root = F.when(F.col("invert"), F.concat(F.lit("w_"), "out")).otherwise(F.col("out"))
    cells = F.concat(F.transform("t.cells", lambda c: F.struct(F.col("base").alias("cell"), c["out"].alias("out"), c["ins"].alias("ins"))), F.array(F.struct(F.col("base").alias("cell"), root.alias("out"), F.col("t.level").alias("ins"))), F.when(F.col("invert"), F.array(F.struct(F.lit("INV_X1").alias("cell"), F.col("out").alias("out"), F.array(root).alias("ins")))).otherwise(F.array().cast("array<struct<cell:string,out:string,ins:array<string>>>")))
    tree = wide.select("name", "seq", F.col("out").alias("gate"), F.posexplode(cells).alias("cell_no", "c")).select("name", "seq", "gate", "cell_no", "c.cell", "c.out", "c.ins")
    return one.unionByName(tree)


def wire(statements: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed netlists. Flip-flops are cut: q is an input, d an output. The first driver of a signal
    wins; pins of undriven signals are dropped. The work is dealt over so many tasks, else over as many as Spark takes."""
    deal = lambda rows, *keys: rows.repartition(tasks, *keys) if tasks else rows
    cells = decompose(statements)
    ins = statements.where("kind IN ('input', 'dff')").select("name", "seq", "out").groupBy("name", "out").agg(F.min("seq").alias("seq"))
    nodes = ins.select("name", F.lit("PI").alias("role"), F.lit("PI").alias("node_type"), F.lit(0).alias("part"), "seq", F.lit(0).alias("sub"), F.col("out").alias("signal"), F.array().cast("array<string>").alias("pins"))
    gates = cells.select("name", F.lit("GATE").alias("role"), F.col("cell").alias("node_type"), F.lit(1).alias("part"), "seq", F.col("cell_no").alias("sub"), F.col("out").alias("signal"), F.col("ins").alias("pins"))
    outs = statements.where("kind IN ('output', 'dff')").select("name", F.lit("PO").alias("role"), F.lit("PO").alias("node_type"), F.lit(2).alias("part"), "seq", F.lit(0).alias("sub"), F.lit(None).cast("string").alias("signal"), F.when(F.col("kind") == "dff", F.col("ins")).otherwise(F.array("out")).alias("pins"))
    every = deal(nodes.unionByName(gates).unionByName(outs), "name")
    order = Window.partitionBy("name").orderBy("part", "seq", "sub", "signal")
    every = every.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    drivers = every.where("signal IS NOT NULL").groupBy("name", "signal").agg(F.min("idx").alias("drv"))
    pins = deal(every.select("name", F.col("idx").alias("snk"), F.explode("pins").alias("signal")), "name", "signal")
    return every.select("name", "idx", "role", "node_type", "signal"), pins.join(drivers, ["name", "signal"]).select("name", "drv", "snk")


@udtf(returnType="cell_no: int, cell: string, out: string, ins: array<string>")
class GateTree:
    """Table function: the cells of one gate (output, function, inputs), any number of inputs, as decompose() gives them."""

    def eval(self, out: str, func: str, ins: list[str]):
        func, k = (func or "").upper(), len(ins or [])
        if not k:
            return
        direct = "INV_X1" if func in ("NOT", "INV") else "BUF_X1" if func in ("BUF", "BUFF", "BUFFER") or k == 1 else DIRECT.get((func, k))
        if direct:
            yield 0, direct, out, ins[:1] if direct in ("INV_X1", "BUF_X1") else ins
            return
        base = "OR2_X1" if func in ("OR", "NOR") else "XOR2_X1" if func in ("XOR", "XNOR") else "AND2_X1"
        number, level, ins = 0, 0, list(ins)
        while len(ins) > 2:
            made = [f"w_{out}_{level}_{i}" for i in range(len(ins) // 2)]
            for i, name in enumerate(made):
                yield number + i, base, name, ins[2 * i : 2 * i + 2]
            number, level, ins = number + len(made), level + 1, made + ins[2 * len(made) :]
        inverted = func in ("NAND", "NOR", "XNOR")
        yield number, base, f"w_{out}" if inverted else out, ins
        if inverted:
            yield number + 1, "INV_X1", out, [f"w_{out}"]


def gate_trees(gates: DataFrame) -> DataFrame:
    """(name, gate, cell_no, cell, out, ins) of gates (name, out, func, ins) by the table function, joined laterally."""
    cells = GateTree(F.col("out").outer(), F.col("func").outer(), F.col("ins").outer())
    return gates.select("name", F.col("out"), "func", "ins").lateralJoin(cells.toDF("cell_no", "cell", "cell_out", "cell_ins")).select("name", F.col("out").alias("gate"), "cell_no", "cell", F.col("cell_out").alias("out"), F.col("cell_ins").alias("ins"))

"""Derived netlists as text in three dialects, the way foreign tools write them.

The texts hold what readers must cope with: comments beside and across statements, either case, ports in one statement,
escaped names, flip-flops, a port that is named twice, a second driver of a signal, and lines that mean nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ordered(rows: DataFrame, line: Column, between: str = "\n") -> DataFrame:
    """(circuit_id, body): the lines of each circuit in order of their nodes."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), between)
    return rows.groupBy("circuit_id").agg(body.alias("body"))


def _pinned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the indices of their drivers in order."""
    pins = edges.groupBy("circuit_id", F.col("snk").alias("idx")).agg(F.sort_array(F.collect_list("drv")).alias("pins"))
    return nodes.select("circuit_id", "idx", "role", "event_id").join(pins, ["circuit_id", "idx"], "left")


def _names(pins: Column, form: str) -> Column:
    return F.transform(pins, lambda k: F.format_string(form, k))


def bench(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): gates are NAND, every eleventh event's is a flip-flop; circuits of even number end with a second driver
    of s4 and the port s0 named again."""
    rows, own = _pinned(nodes, edges), F.format_string("s%d", "idx")
    pins = F.array_join(_names(F.col("pins"), "s%d"), " , ")
    gate = F.concat(own, F.when(F.col("event_id") % 11 == 0, " = DFF(").otherwise(" = nand( "), pins, F.lit(")  # gate "), F.col("idx").cast("string"))
    line = F.when(F.col("role") == "PI", F.concat(F.lit("  Input( "), own, F.lit(" )"))).when(F.col("role") == "PO", F.concat(F.lit("OUTPUT("), F.format_string("s%d", F.col("pins")[0]), F.lit(")"))).otherwise(gate)
    end = F.when(F.col("circuit_id") % 2 == 0, "\ns4 = NOT(s0)\nINPUT(s0)").otherwise("")
    text = F.concat(F.lit("# a netlist\n\njunk line\ns9 = NAND(\n"), "body", end, F.lit("\n"))
    return _ordered(rows, line).select(F.col("circuit_id").cast("string").alias("name"), text.alias("text"))


def verilog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): gate primitives with and without instance names, over several lines; the ports in one statement each."""
    rows = _pinned(nodes, edges)
    kind = F.element_at(F.array(*map(F.lit, ("and", "nand", "or", "nor", "xor", "xnor"))), (F.col("idx") % 6 + 1).cast("int"))
    kind = F.when(F.col("role") == "PO", "buf").when(F.size("pins") == 1, "not").otherwise(kind)
    out = F.when(F.col("role") == "PO", F.format_string("o%d", "idx")).otherwise(F.format_string("s%d", "idx"))
    instance = F.when(F.col("idx") % 2 == 0, F.format_string(" U%d ", "idx")).otherwise("")
    statement = F.concat(kind, instance, F.lit("("), out, F.lit(", /* pins\n of it */\n "), F.array_join(_names(F.col("pins"), "s%d"), " ,"), F.lit(");"), F.lit(" // next"))
    body = _ordered(rows.where("role <> 'PI'"), statement)
    ports = lambda role, form: _ordered(rows.where(F.col("role") == role), F.format_string(form, "idx"), ",\n  ")
    both = body.join(ports("PI", "s%d").withColumnRenamed("body", "ins"), "circuit_id").join(ports("PO", "o%d").withColumnRenamed("body", "outs"), "circuit_id")
    text = F.concat(F.lit("// input not a port;\nmodule m ("), "ins", F.lit(", "), "outs", F.lit(");\ninput "), "ins", F.lit(";\noutput "), "outs", F.lit(";\nwire w;\n"), "body", F.lit("\nendmodule\n"))
    return both.select(F.col("circuit_id").cast("string").alias("name"), text.alias("text"))


def assigns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): flattened assignments of escaped names; a gate joins its first driver and the negation of its second,
    or negates its only one; the gates come first, then the outputs."""
    rows = _pinned(nodes, edges)
    signal = lambda k: F.format_string("\\s[%d] ", k)
    first, second = F.col("pins")[0], F.get("pins", F.lit(1))
    join = F.when(F.col("idx") % 2 == 0, " & ").otherwise(" | ")
    right = F.when(F.size("pins") == 1, F.concat(F.lit("~"), signal(first))).otherwise(F.concat(signal(first), join, F.lit("~"), signal(second)))
    out = F.when(F.col("role") == "PO", F.format_string("\\o[%d] ", "idx")).otherwise(signal(F.col("idx")))
    statement = F.concat(F.lit("assign "), out, F.lit("= "), F.when(F.col("role") == "PO", signal(first)).otherwise(right), F.lit(";"))
    body = _ordered(rows.where("role <> 'PI'"), statement)
    ports = lambda role, form: _ordered(rows.where(F.col("role") == role), F.format_string(form, "idx"), ", ")
    both = body.join(ports("PI", "\\s[%d] ").withColumnRenamed("body", "ins"), "circuit_id").join(ports("PO", "\\o[%d] ").withColumnRenamed("body", "outs"), "circuit_id")
    text = F.concat(F.lit("module top( "), "ins", F.lit(" , "), "outs", F.lit(" );\ninput "), "ins", F.lit(";\noutput "), "outs", F.lit(";\n"), "body", F.lit("\nendmodule\n"))
    return both.select(F.col("circuit_id").cast("string").alias("name"), text.alias("text"))

"""Assembly text to programs and back: each line is matched against the shapes of the operations, inside the row.

A line is an optional ``L<n>:``, an operation in any case and its arguments, split by blanks; a minus also starts a new
word, so that ``LOAD R0-93`` is read. ``;`` starts a comment. A line with a label alone is a NOP. Userops have no text form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa


def words(line: Column) -> Column:
    """Words of a line without its comment and label."""
    bare = F.regexp_replace(line, ";.*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s*L[0-9]+\s*:", ""), r"(?<=\S)-", " -")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def _line(line: Column, number: Column) -> Column:
    label = F.regexp_extract(line, r"^\s*(L[0-9]+)\s*:", 1)
    return isa.given(F.struct(words(line).alias("w"), label.alias("label")), lambda x: _read_line(x["w"], x["label"], number))


def _read_line(w: Column, label: Column, number: Column) -> Column:
    shape = isa.literal_map({n: F.struct(F.lit(isa.OPS[n].registers).alias("regs"), F.lit(isa.OPS[n].registers + isa.OPS[n].literals + isa.OPS[n].jumps).alias("all")) for n in isa.BASE})
    op = F.upper(F.get(w, F.lit(0)))
    head = F.struct(op.alias("op"), F.try_element_at(shape, op).alias("shape"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("rest"))
    return isa.given(head, lambda h: _checked_line(w, label, number, h["op"], h["shape"], h["rest"]))


def _checked_line(w: Column, label: Column, number: Column, op: Column, shape: Column, rest: Column) -> Column:
    jumps = op.isin("JZ", "JMP")

    def bad(x: Column, i: Column) -> Column:
        want = F.when(i < shape["regs"], "register").when(jumps, "label").otherwise("number")
        ok = F.when(i < shape["regs"], x.rlike("^[Rr][0-7]$")).when(jumps, x.rlike("^L[0-9]+$")).otherwise(x.rlike("^-?[0-9]{1,9}$"))
        return F.when(~ok, F.concat(F.lit("not a "), want, F.lit(": "), x))

    wrong = F.get(F.array_compact(F.transform(rest, bad)), F.lit(0))
    message = F.when(F.size(w) > 0, F.when(shape.isNull(), F.concat(F.lit("unknown operation: "), F.get(w, F.lit(0)))).when(F.size(rest) != shape["all"], F.concat(op, F.lit(" takes "), shape["all"].cast("string"), F.lit(" arguments"))).otherwise(wrong))
    args = F.transform(F.filter(rest, lambda x: ~x.startswith("L")), lambda x: F.regexp_replace(x, "^[Rr]", "").try_cast("int"))
    target = F.when(jumps, F.try_element_at(rest, F.lit(-1)))
    made = F.struct(F.when(F.size(w) > 0, op).otherwise("NOP").alias("op"), args.alias("args"), F.when(label != "", label).alias("label"), target.alias("target"))
    used = (F.size(w) > 0) | (label != "")
    return isa.given(message, lambda m: F.struct((number + 1).cast("int").alias("line"), F.when(used & m.isNull(), made).alias("x"), F.when(used, m).alias("message"), used.alias("used")))


def parse(df: DataFrame, source: str = "source") -> DataFrame:
    """``df`` with ``program``, ``errors`` (line from 1, message) and ``lines`` (instruction index of each line, or null).

    Every bad line is told; so is a second definition of a label, at its own line. With any error there is no program.
    An empty text is an empty program; a null one gives nulls.
    """
    keep = [c for c in df.columns if c not in ("program", "errors", "lines")]
    read = F.transform(F.split(F.col(source), "\r?\n", -1), _line)
    out = isa.once(df.select(*keep), "_read", read) if source in keep else isa.once(df, "_read", read).select(*keep, "_read")
    kept = F.filter(F.col("_read"), lambda r: r["used"])
    seen = lambda names: F.transform(F.col("_read"), lambda r, i: F.when(r["x"]["label"].isNotNull() & (F.array_position(names, r["x"]["label"]) <= i), F.struct(r["line"].alias("line"), F.concat(F.lit("label defined twice: "), r["x"]["label"]).alias("message"))))
    twice = isa.given(F.transform(F.col("_read"), lambda r: r["x"]["label"]), seen)
    told = F.transform(F.filter(F.col("_read"), lambda r: r["message"].isNotNull()), lambda r: F.struct(r["line"].alias("line"), r["message"].alias("message")))
    errors = F.array_sort(F.concat(told, F.array_compact(twice)))
    # a used line's index is its place among the numbers of used lines
    lines = isa.given(F.transform(kept, lambda r: r["line"]), lambda used: F.transform(F.col("_read"), lambda r: F.when(r["used"], (F.array_position(used, r["line"]) - 1).cast("int"))))
    out = out.withColumns({"errors": errors, "lines": lines})
    return out.withColumn("program", F.when(F.size("errors") == 0, F.transform(kept, lambda r: r["x"]).cast(isa.PROGRAM))).select(*keep, "program", "errors", "lines")


def render(program: Column) -> Column:
    """Canonical text: ``L3:ADD R0 R1 R2`` and a newline for each instruction; userops by the name of their slot."""
    takes = lambda n: [o.name for o in isa.OPS.values() if o.registers <= n]

    def number(op: Column, i: Column) -> Column:
        """Whether argument ``i`` is shown as it is: no register, or one of an unknown operation."""
        few = reduce(lambda x, n: x | (i >= n) & op.isin(takes(n)), (2, 1, 0), i >= 3)
        return few | ~F.coalesce(op.isin(list(isa.OPS)), F.lit(False))

    def one(x: Column) -> Column:
        args = F.transform(x["args"], lambda a, i: F.when(number(x["op"], i), a.cast("string")).otherwise(F.concat(F.lit("R"), a.cast("string"))))
        tail = F.when(x["target"].isNotNull(), F.array(x["target"])).otherwise(F.array().cast("array<string>"))
        return F.concat(F.coalesce(F.concat(x["label"], F.lit(":")), F.lit("")), F.array_join(F.concat(F.array(x["op"]), args, tail), " "), F.lit("\n"))

    return F.array_join(F.transform(program, one), "")


#: Word classes for display, by pattern, tried in order.
CLASSES = {"comment": ";.*", "label": "L[0-9]+:?", "register": "[Rr][0-7]", "number": "-?[0-9]+", "operation": "(?i:" + "|".join(isa.BASE) + ")"}


def classes(df: DataFrame, ids: list[str], source: str = "source") -> DataFrame:
    """Words of a source text with their class (``invalid`` for any other): ids, line, k, word, class."""
    lines = df.select(*ids, F.posexplode(F.split(source, "\r?\n", -1)).alias("_n", "_text"))
    cut = F.regexp_extract_all(F.col("_text"), F.lit(r"(;.*|L[0-9]+:|-?[^\s;-]+|-)"), 1)
    found = lines.select(*ids, (F.col("_n") + 1).alias("line"), F.posexplode(cut).alias("k", "word"))
    kind = F.lit("invalid")
    for name, pattern in reversed(CLASSES.items()):
        kind = F.when(F.col("word").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return found.withColumn("class", kind)

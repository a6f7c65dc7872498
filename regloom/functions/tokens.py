"""Programs and traces as token ids and as text, and back.

Token sequences are ARRAY<INT> columns over the 64 tokens of ``isa.TOKENS``. Labels: ``L<n>`` keeps its number; any other
label is numbered 10001, 10002, ... by its first definition in the program (targets that nothing defines follow).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isa

_INTS = "array<int>"


def _ids(*tokens: str) -> Column:
    return F.array(*(F.lit(isa.ID[t]) for t in tokens)).cast(_INTS)


def _digits(text: Column) -> Column:
    """Ids of a text of digits and a leading minus."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(c == "-", isa.ID["MINUS"]).otherwise(F.ascii(c) - ord("0") + isa.ID["0"]).cast("int"))


def number(x: Column) -> Column:
    """Ids of a signed number."""
    return _digits(x.cast("string"))


def _label_number(label: Column, others: Column) -> Column:
    plain = F.regexp_extract(label, "^L([0-9]+)$", 1)
    place = F.array_position(others, label)
    return F.when(plain != "", F.regexp_replace(plain, "^0+(?=[0-9])", "")).otherwise((place + 10000).cast("string"))


def other_labels(program: Column) -> Column:
    """Labels not of the form L<n>, by first definition, then targets without one."""
    named = F.concat(F.transform(program, lambda x: x["label"]), F.transform(program, lambda x: x["target"]))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull() & ~x.rlike("^L[0-9]+$")))


def _op_id(op: Column, bindings: dict[str, str]) -> Column:
    ids = {name: isa.ID[name] for name in isa.BASE} | {slot: isa.ID[symbol] for slot, symbol in bindings.items()}
    return isa.literal_map(ids)[op].cast("int")


def line(x: Column, others: Column, bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """Ids of one instruction with its NEWLINE."""
    shape = {o.name: o.registers for o in isa.OPS.values()}
    regs = F.transform(F.slice(x["args"], 1, isa.literal_map(shape)[x["op"]]), lambda r: (r + isa.ID["R0"]).cast("int"))
    defined = F.when(x["label"].isNotNull(), F.concat(_ids("L"), _digits(_label_number(x["label"], others)), _ids("COLON"))).otherwise(F.array().cast(_INTS))
    literal = F.when(x["op"] == "LOAD", number(F.try_element_at(x["args"], F.lit(2)))).otherwise(F.array().cast(_INTS))
    jump = F.when(x["op"].isin("JZ", "JMP"), F.concat(_ids("L"), _digits(_label_number(x["target"], others)))).otherwise(F.array().cast(_INTS))
    return F.concat(defined, F.array(_op_id(x["op"], bindings)), regs, literal, jump, _ids("NEWLINE"))


def encode(program: Column, bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """Ids of a program. A userop is written as the symbol bound to its slot."""
    others = other_labels(program)
    return F.flatten(F.transform(program, lambda x: line(x, others, bindings)))


def _values(output: Column) -> Column:
    return F.flatten(F.transform(output, lambda v: F.concat(number(v), _ids("NEWLINE"))))


def _prompt(body: Column, target: Column) -> Column:
    return F.struct(F.concat(_ids("BOS"), body, _ids("EOS")).alias("input_ids"), F.concat(_ids("BOS"), target, _ids("EOS")).alias("target_ids"))


def render_direct(program: Column, trace: Column) -> Column:
    """input: the program; target: each output value on a line."""
    return _prompt(encode(program), _values(trace["output"]))


def registers(regs: Column, before: Column | None = None) -> Column:
    """``Ri = value`` for all registers, or for those that differ from ``before``."""
    each = F.transform(regs, lambda v, i: F.when(F.lit(True) if before is None else v != F.get(before, i), F.concat(F.array((i + isa.ID["R0"]).cast("int")), _ids("EQUALS"), number(v))).otherwise(F.array().cast(_INTS)))
    return F.flatten(each)


def render_cot(program: Column, trace: Column, mode: str = "full") -> Column:
    """target: for each step its instruction and the registers after it (``modified``: those that changed), then the output."""
    if mode not in ("full", "modified"):
        raise ValueError(f"mode is 'full' or 'modified', not {mode!r}")
    others, zeros = other_labels(program), F.array_repeat(F.lit(0), isa.REGISTERS)
    past = F.transform(trace["steps"], lambda s: s["regs"])

    def told(s: Column, t: Column) -> Column:
        before = F.coalesce(F.get(past, t - 1), zeros) if mode == "modified" else None
        return F.concat(line(F.get(program, s["pc"]), others), registers(s["regs"], before), _ids("NEWLINE"))

    return _prompt(encode(program), F.concat(F.flatten(F.transform(trace["steps"], told)), _values(trace["output"])))


def render_probe(program: Column, trace: Column, t: Column) -> Column:
    """input: the program up to the instruction of step ``t`` (by place, not by order of execution) and ``?``; target: the registers then."""
    step = F.get(trace["steps"], t)
    return _prompt(F.concat(encode(F.slice(program, 1, step["pc"] + 1)), _ids("?")), F.concat(registers(step["regs"]), _ids("NEWLINE")))


def templates_of(given: dict[str, list[tuple[str, list[int]]]]) -> Column:
    """Templates by symbol as a map column, from (operation, arguments) lines; ``expand.check_templates`` tells bad ones."""
    lines = lambda rows: F.array(*(isa.instruction(op, args) for op, args in rows)).cast(isa.PROGRAM) if rows else F.array().cast(isa.PROGRAM)
    return F.create_map(*(x for symbol, rows in given.items() for x in (F.lit(symbol), lines(rows))))


def decomposed(program: Column, templates: Column, bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """Ids of a program in which every userop is followed by DECOMP and the lines of its template, with the call's registers.

    A userop without a template makes the row fail.
    """
    others, symbols = other_labels(program), isa.literal_map(bindings)
    regs = isa.literal_map({o.name: o.registers for o in isa.OPS.values()})

    def told(x: Column) -> Column:
        found = F.try_element_at(templates, F.try_element_at(symbols, x["op"]))
        found = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no template for "), x["op"])).cast(isa.PROGRAM)).otherwise(found)

        def filled(t: Column) -> Column:
            args = F.transform(t["args"], lambda a, k: F.when(k < F.try_element_at(regs, t["op"]), F.get(x["args"], a)).otherwise(a))
            return line(F.struct(t["op"].alias("op"), args.alias("args"), F.lit(None).cast("string").alias("label"), t["target"].alias("target")), others, bindings)

        called = F.try_element_at(symbols, x["op"]).isNotNull()
        return F.concat(line(x, others, bindings), F.when(called, F.concat(_ids("DECOMP"), F.flatten(F.transform(found, filled)))).otherwise(F.array().cast(_INTS)))

    return F.flatten(F.transform(program, told))


def render_userops(demos: Column, target: Column, templates: Column | None = None, bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """input: each demonstration's program and output, then the target's program; target: its output.

    ``demos``: an array of structs (program with userops, output of its expansion); ``target``: one such struct.
    ``templates``: a map of symbol to lines; with it, demonstrations show what each userop stands for, the target never does.
    """
    shown = lambda p: encode(p, bindings) if templates is None else decomposed(p, templates, bindings)
    told = F.flatten(F.transform(demos, lambda d: F.concat(shown(d["program"]), _values(d["output"]))))
    return _prompt(F.concat(told, encode(target["program"], bindings)), _values(target["output"]))


def probe_targets(trace: Column) -> Column:
    """Registers after each step."""
    return F.transform(trace["steps"], lambda s: s["regs"])


def _shown(i: int, name: str) -> str:
    """What a token adds to a text."""
    if name in ("BOS", "EOS", "PAD"):
        return ""
    fixed = {"NEWLINE": "\n", "COLON": ":", "EQUALS": "=", "MINUS": "-", "L": "L"}
    return fixed.get(name, name if name.isdigit() else name + " ")


def text(ids: Column) -> Column:
    """Surface text. Operations, registers, ``?`` and DECOMP end in a space, which ``:``, ``=`` and ``-`` take away."""
    shown = F.array(*(F.lit(_shown(i, name)) for i, name in enumerate(isa.TOKENS)))
    return F.regexp_replace(F.array_join(F.transform(ids, lambda i: F.get(shown, i)), ""), " (?=[:=-])", "")


def with_text(prompt: Column) -> Column:
    """A prompt with both texts."""
    return F.struct(prompt["input_ids"].alias("input_ids"), prompt["target_ids"].alias("target_ids"), text(prompt["input_ids"]).alias("input_text"), text(prompt["target_ids"]).alias("target_text"))


#: Renders by name, for datasets.
RENDERS = {"direct": render_direct, "cot": render_cot}


def renders(program: Column, trace: Column, modes: list[str]) -> Column:
    """A struct of prompts with texts; an unknown name raises KeyError."""
    return F.struct(*(with_text(RENDERS[m](program, trace)).alias(m) for m in modes)) if modes else F.lit(None).cast("struct<>")


def spelled(ids: Column) -> Column:
    """Token names joined by spaces; null if any id is outside the vocabulary."""
    known = F.array(*(F.lit(t) for t in isa.TOKENS))
    return F.when(F.forall(ids, lambda i: i.between(0, len(isa.TOKENS) - 1)), F.array_join(F.transform(ids, lambda i: F.get(known, i)), " "))


def _line_pattern() -> str:
    """A regular expression of one line's token names, by the shapes of the operations."""
    reg, digits = " R[0-7]", "( [0-9])+"
    shapes: dict[str, list[str]] = {}
    for o in isa.OPS.values():
        tail = reg * o.registers + f"( MINUS)?{digits}" * o.literals + f" L{digits}" * o.jumps
        shapes.setdefault(tail, []).append(isa.BINDINGS.get(o.name, o.name))
    return rf"^(L{digits} COLON )?(" + "|".join(f"({'|'.join(v)}){tail}" for tail, v in shapes.items()) + ")$"


def decode(ids: Column, bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """Struct (program, error). A sequence that is no program has a null program and the first bad line as its error.

    Labels come back as L<n>; symbols come back as the slots they are bound to.
    """
    ok = _line_pattern()
    for slot, symbol in bindings.items():
        ok = ok.replace(isa.BINDINGS[slot], symbol)
    slots = isa.literal_map({symbol: slot for slot, symbol in bindings.items()})
    joined_number = lambda found: F.translate(F.replace(found, F.lit("MINUS"), F.lit("-")), " ", "")
    named = lambda n: F.when(n != "", F.concat(F.lit("L"), F.regexp_replace(n, "^0+(?=[0-9])", "")))

    def read(label: Column, rest: Column) -> Column:
        """An instruction from its label and from its words after it."""
        op, last = F.substring_index(rest, " ", 1), F.regexp_extract(rest, " ((?:L|MINUS)?(?: ?[0-9])+)$", 1)
        number = joined_number(F.regexp_replace(last, "^L ", ""))
        args = F.transform(F.regexp_extract_all(rest, F.lit(" R([0-7])"), 1), lambda r: r.cast("int"))
        args = F.when(op == "LOAD", F.concat(args, F.array(number.try_cast("int")))).otherwise(args)
        return F.struct(F.coalesce(F.try_element_at(slots, op), op).alias("op"), args.alias("args"), named(label).alias("label"), named(F.when(op.isin("JZ", "JMP"), number).otherwise("")).alias("target"))

    def parsed(x: Column) -> Column:
        head = F.when(x.startswith("L "), F.regexp_extract(x, "^L((?: [0-9])+) COLON ", 1)).otherwise("")
        cut = isa.given(head, lambda h: F.struct(h.alias("h"), F.when(h != "", F.substr(x, F.length(h) + 9)).otherwise(x).alias("rest")))
        return isa.given(cut, lambda c: read(F.translate(c["h"], " ", ""), c["rest"]))

    def told(ids: Column, joined: Column, lines: Column) -> Column:
        bad = F.get(F.filter(lines, lambda x: ~x.rlike(ok)), F.lit(0))
        whole = (F.size(ids) == 0) | (F.element_at(ids, -1) == isa.ID["NEWLINE"])
        error = isa.given(bad, lambda b: F.when(ids.isNull(), F.lit(None)).when(joined.isNull(), "unknown id").when(b.isNotNull(), F.concat(F.lit("bad line: "), b)).when(~whole, "no NEWLINE at the end"))
        return isa.given(error, lambda e: F.struct(F.when(e.isNull() & ids.isNotNull(), F.transform(lines, parsed)).alias("program"), e.alias("error")))

    cut = lambda joined: F.filter(F.split(joined, " ?NEWLINE ?"), lambda x: x != "")
    return isa.given(ids, lambda i: isa.given(spelled(i), lambda joined: isa.given(cut(joined), lambda lines: told(i, joined, lines))))


def values(ids: Column) -> Column:
    """Numbers of a value stream, BOS and EOS at its ends left out; null if it is malformed."""
    joined = F.regexp_replace(F.regexp_replace(spelled(ids), "^BOS( |$)", ""), "(^| )EOS$", "")
    ok = joined.rlike("^((MINUS )?([0-9]( |$))*(MINUS$)?(NEWLINE( |$))?)*$")
    packed = F.regexp_replace(F.regexp_replace(joined, "MINUS ?", "-"), "(?<=[0-9]) (?=[0-9])", "")
    found = F.regexp_extract_all(packed, F.lit("(-?[0-9]+)"), 1)
    return F.when(ok, F.transform(found, lambda x: x.cast("decimal(38,0)")))


def score(predicted: Column, target: Column) -> Column:
    """1.0 if both streams hold the same numbers, else 0.0; a malformed stream or unknown id scores 0.0."""
    return F.when(values(predicted) == values(target), 1.0).otherwise(0.0)

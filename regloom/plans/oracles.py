"""DuckDB SQL with the same rows as the queries of the same names."""

from __future__ import annotations

from ..functions import isa

_ARRAY = "array_to_string({0}, ',')"

OPERANDS = """o AS (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 37 + l_linenumber) % 2048 - 1024 AS BIGINT) AS a,
  CAST((l_suppkey * 7 + CAST(l_quantity AS BIGINT)) % 41 - 20 AS BIGINT) AS b FROM lineitem)"""


def clamped(x: str) -> str:
    return f"greatest({isa.LOW}, least({isa.HIGH}, {x}))"


ALU = {
    "load": clamped("3 * a"),
    "mov": "a",
    "add": clamped("a + b"),
    "sub": clamped("a - b"),
    "mul": clamped("a * b"),
    "div": f"CASE WHEN b = 0 THEN 0 ELSE {clamped('sign(a) * sign(b) * (abs(a) // abs(b))')} END",
    "neg": clamped("-a"),
    "eq": "CASE WHEN a = b THEN 1 ELSE 0 END",
    "lt": "CASE WHEN a < b THEN 1 ELSE 0 END",
}


def names(kind: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in kind) + "]"


def code(jumps: bool = False) -> str:
    """CTEs: line (the fields of order lines), size, code (id, pc, op, a, b, c, lit, t)."""
    ops = isa.BASE if jumps else isa.FILL
    line = f"""line AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INT) AS pc,
  {names(ops)}[CAST(l_partkey % {len(ops)} AS INT) + 1] AS op, CAST(l_suppkey % 8 AS INT) AS a, CAST(l_linenumber % 8 AS INT) AS b, CAST(CAST(l_quantity AS BIGINT) % 8 AS INT) AS c,
  CAST(l_partkey % 255 - 127 AS INT) AS lit, CAST(l_suppkey % 3 AS INT) AS jump FROM lineitem),
size AS (SELECT id, CAST(count(*) AS INT) AS n FROM line GROUP BY id)"""
    if jumps:
        return line + """,
code AS (SELECT id, pc, op, a, b, c, lit, least(pc + 1 + jump, n) AS t FROM line JOIN size USING (id)
  UNION ALL SELECT id, n, 'HALT', 0, 0, 0, 0, 0 FROM size)"""
    return line + """,
code AS (SELECT id, pc, op, a, b, c, lit, 0 AS t FROM line
  UNION ALL SELECT id, n, 'PRINT', a, 0, 0, 0, 0 FROM size JOIN line USING (id) WHERE pc = n - 1
  UNION ALL SELECT id, n + 1, 'HALT', 0, 0, 0, 0, 0 FROM size)"""


_VALUE = f"""CASE op WHEN 'LOAD' THEN {clamped('lit')} WHEN 'MOV' THEN regs[b + 1] WHEN 'ADD' THEN {clamped('regs[b + 1] + regs[c + 1]')}
  WHEN 'SUB' THEN {clamped('regs[b + 1] - regs[c + 1]')} WHEN 'MUL' THEN {clamped('regs[b + 1] * regs[c + 1]')}
  WHEN 'DIV' THEN CASE WHEN regs[c + 1] = 0 THEN 0 ELSE {clamped('CAST(sign(regs[b + 1]) * sign(regs[c + 1]) * (abs(regs[b + 1]) // greatest(abs(regs[c + 1]), 1)) AS INT)')} END
  WHEN 'NEG' THEN {clamped('-regs[b + 1]')} WHEN 'EQ' THEN CAST(regs[b + 1] = regs[c + 1] AS INT) WHEN 'LT' THEN CAST(regs[b + 1] < regs[c + 1] AS INT)
  WHEN 'POP' THEN stack[len(stack)] END"""

#: Steps of all programs: t, ran (the instruction), pc (the next), and the state after it; t = 0 is the start.
VM = f"""vm AS (
  SELECT id, 0 AS t, CAST(NULL AS INT) AS ran, 0 AS pc, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS INT[]) AS regs, CAST([] AS INT[]) AS stack, CAST([] AS INT[]) AS output, CAST(NULL AS INT) AS emitted, 'running' AS status FROM size
  UNION ALL
  SELECT id, t + 1, pc, CASE WHEN fault IS NOT NULL THEN pc WHEN op = 'JMP' OR op = 'JZ' AND regs[a + 1] = 0 THEN target ELSE pc + 1 END,
    CASE WHEN fault IS NULL AND op IN {tuple(isa.WRITING)} THEN list_concat(list_concat(regs[1:a], [CAST(v AS INT)]), regs[a + 2:8]) ELSE regs END,
    CASE WHEN fault IS NOT NULL THEN stack WHEN op = 'PUSH' THEN list_append(stack, regs[a + 1]) WHEN op = 'POP' THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN op = 'PRINT' THEN list_append(output, regs[a + 1]) ELSE output END, CASE WHEN op = 'PRINT' THEN regs[a + 1] END,
    CASE WHEN fault IS NOT NULL THEN fault WHEN op = 'HALT' THEN 'halted' ELSE 'running' END
  FROM (SELECT vm.*, op, a, code.t AS target, {_VALUE} AS v,
      CASE WHEN op = 'PUSH' AND len(stack) >= {isa.DEPTH} THEN 'stack_overflow' WHEN op = 'POP' AND len(stack) = 0 THEN 'stack_underflow' END AS fault
    FROM vm JOIN code ON vm.id = code.id AND vm.pc = code.pc WHERE status = 'running')
),
ended AS (SELECT * FROM vm WHERE status <> 'running'),
steps AS (SELECT id, CAST(t - 1 AS BIGINT) AS t, CAST(ran AS BIGINT) AS pc, regs, stack, emitted FROM vm WHERE t > 0 AND status IN ('running', 'halted'))"""


def machine(select: str, jumps: bool = False) -> str:
    return f"WITH RECURSIVE {code(jumps)},\n{VM}\n{select}"


# Tokens: the ids of an instruction and of a number, as lists.
def number(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}::VARCHAR, ''), lambda ch: ch <> ''), lambda ch: CASE WHEN ch = '-' THEN {isa.ID['MINUS']} ELSE ascii(ch) - 48 + {isa.ID['0']} END)"


_THREE = tuple(n for n in isa.BASE if isa.OPS[n].registers == 3)
_R = isa.ID["R0"]


def line_ids(op_ids: dict[str, int]) -> str:
    op = "CASE op " + " ".join(f"WHEN '{n}' THEN {i}" for n, i in op_ids.items()) + " END"
    return f"""list_concat(list_concat([{op}], CASE WHEN op = 'LOAD' THEN list_concat([{_R} + a], {number('lit')}) WHEN op IN {_THREE} THEN [{_R} + a, {_R} + b, {_R} + c]
  WHEN op IN ('MOV', 'NEG') THEN [{_R} + a, {_R} + b] WHEN op = 'PRINT' THEN [{_R} + a] ELSE [] END), [{isa.ID['NEWLINE']}])"""


_LINES = f"lines AS (SELECT id, pc, {line_ids({n: isa.ID[n] for n in isa.BASE})} AS ids FROM code)"
_PROGRAMS = "programs AS (SELECT id, flatten(list(ids ORDER BY pc)) AS ids FROM lines GROUP BY id)"
_TEXT = """CASE op WHEN 'LOAD' THEN 'LOAD R' || a || CASE WHEN lit < 0 THEN '' ELSE ' ' END || lit WHEN 'HALT' THEN 'HALT ' WHEN 'PRINT' THEN 'PRINT R' || a || ' '
  WHEN 'MOV' THEN 'MOV R' || a || ' R' || b || ' ' WHEN 'NEG' THEN 'NEG R' || a || ' R' || b || ' ' ELSE op || ' R' || a || ' R' || b || ' R' || c || ' ' END || chr(10)"""
_ASM = """CASE op WHEN 'LOAD' THEN 'LOAD R' || a || ' ' || lit WHEN 'HALT' THEN 'HALT' WHEN 'PRINT' THEN 'PRINT R' || a
  WHEN 'MOV' THEN 'MOV R' || a || ' R' || b WHEN 'NEG' THEN 'NEG R' || a || ' R' || b ELSE op || ' R' || a || ' R' || b || ' R' || c END || chr(10)"""
_REGS = "R0=' || regs[1] || 'R1=' || regs[2] || 'R2=' || regs[3] || 'R3=' || regs[4] || 'R4=' || regs[5] || 'R5=' || regs[6] || 'R6=' || regs[7] || 'R7=' || regs[8]"
_CHANGED = " || ".join(f"CASE WHEN regs[{r + 1}] <> before[{r + 1}] THEN 'R{r}=' || regs[{r + 1}] ELSE '' END" for r in range(8))
_BEFORE = "coalesce(lag(regs) OVER (PARTITION BY id ORDER BY t), [0, 0, 0, 0, 0, 0, 0, 0])"


def cot(regs: str) -> str:
    return machine(f""", told AS (SELECT s.id, s.t, {_TEXT} || {regs} || chr(10) AS x FROM (SELECT *, {_BEFORE} AS before FROM steps) s JOIN code ON s.id = code.id AND s.pc = code.pc)
SELECT told.id, string_agg(x, '' ORDER BY told.t) || any_value(o) AS text FROM told JOIN (SELECT id, coalesce(array_to_string(list_transform(output, lambda v: v || chr(10)), ''), '') AS o FROM ended) USING (id) GROUP BY told.id""")


# Seeds and draws.
SEEDED = "s AS (SELECT o_orderkey AS id, CAST(('0x' || substr(sha256('0|train|' || lower(o_orderpriority) || '|' || o_orderkey), 1, 16))::UBIGINT AS VARCHAR) AS seed FROM orders)"


def drawn(h: str, i: int | str) -> str:
    at = f"{8 * i + 1}" if isinstance(i, int) else f"8 * {i} + 1"
    return f"CAST(('0x' || substr({h}, {at}, 8))::UBIGINT AS BIGINT)"


_ORDER = "list_transform(list_sort(list_transform(range(8), lambda r: substr(sha256(seed || '|registers'), CAST(8 * r + 1 AS INT), 8) || r)), lambda x: CAST(x[9] AS INT))"

GEN_COUNTER = f"""WITH {SEEDED},
n AS (SELECT *, CAST(id % 5 + 4 AS INT) AS n FROM s),
body AS (SELECT id, i, ['ADD R0 R0 R0', 'SUB R0 R0 R0', 'NEG R0 R0', 'MOV R0 R0'][CAST({drawn("sha256(seed || '|op|' || i)", 0)} % 4 AS INT) + 1] AS x FROM (SELECT *, unnest(range(1, n)) AS i FROM n))
SELECT n.id, 'LOAD R0 ' || ({drawn("sha256(any_value(seed) || '|start')", 0)} % 255 - 127) || chr(10) || string_agg(x || chr(10), '' ORDER BY i) || 'PRINT R0' || chr(10) || 'HALT' || chr(10) AS text
FROM n JOIN body USING (id) GROUP BY n.id"""

GEN_REGISTER = f"""WITH {SEEDED},
n AS (SELECT *, CAST(id % 5 + 4 AS INT) AS n, CAST(id % 7 + 2 AS INT) AS k, {_ORDER} AS r FROM s),
d AS (SELECT id, i, k, r, sha256(seed || '|fill|' || i) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)),
f AS (SELECT id, i, {names(isa.FILL)}[CAST({drawn('h', 0)} % 9 AS INT) + 1] AS op, r[CAST({drawn('h', 1)} % k AS INT) + 1] AS a, r[CAST({drawn('h', 2)} % k AS INT) + 1] AS b,
  r[CAST({drawn('h', 3)} % k AS INT) + 1] AS c, {drawn('h', 4)} % 255 - 127 AS lit FROM d)
SELECT id, string_agg({_ASM}, '' ORDER BY i) || 'PRINT R' || arg_max(a, i) || chr(10) || 'HALT' || chr(10) AS text FROM f GROUP BY id"""

# Macro expansion.
_SLOTS = "CASE op WHEN 'MOV' THEN 'DOUBLE' WHEN 'EQ' THEN 'MAX' WHEN 'NEG' THEN 'ABS' END"
_EXPANDED = f"""m AS (SELECT *, {_SLOTS} AS symbol FROM code),
x AS (
  SELECT id, pc, 0 AS k, op, CASE WHEN op = 'LOAD' THEN [a, lit] WHEN op IN {_THREE} THEN [a, b, c] WHEN op = 'PRINT' THEN [a] ELSE [] END AS args FROM m WHERE symbol IS NULL
  UNION ALL SELECT id, pc, 0, 'ADD', [a, b, b] FROM m WHERE symbol = 'DOUBLE'
  UNION ALL SELECT id, pc, 0, 'LT', [a, b, c] FROM m WHERE symbol = 'MAX' UNION ALL SELECT id, pc, 1, 'MUL', [a, a, c] FROM m WHERE symbol = 'MAX'
  UNION ALL SELECT id, pc, 0, 'LOAD', [a, -1] FROM m WHERE symbol = 'ABS' UNION ALL SELECT id, pc, 1, 'MUL', [a, a, b] FROM m WHERE symbol = 'ABS')"""
_X_TEXT = "CASE op WHEN 'LOAD' THEN 'LOAD R' || args[1] || ' ' || args[2] WHEN 'HALT' THEN 'HALT' ELSE op || ' ' || array_to_string(list_transform(args, lambda v: 'R' || v), ' ') END || chr(10)"

_CALL_TEXT = f"CASE op WHEN 'MOV' THEN 'DOUBLE R' || a || ' R' || b || ' ' || chr(10) WHEN 'NEG' THEN 'ABS R' || a || ' R' || b || ' ' || chr(10) WHEN 'EQ' THEN 'MAX R' || a || ' R' || b || ' R' || c || ' ' || chr(10) ELSE {_TEXT} END"


def userops(shown: bool) -> str:
    """Prompts of customers: programs with calls, run as expanded ones; ``shown``: with the calls' templates."""
    calls = {n: isa.ID[n] for n in isa.BASE} | {"MOV": isa.ID["DOUBLE"], "EQ": isa.ID["MAX"], "NEG": isa.ID["ABS"]}
    part = "list_concat(own.ids, CASE WHEN dec.ids IS NULL THEN [] ELSE list_concat([%d], dec.ids) END)" % isa.ID["DECOMP"] if shown else "own.ids"
    text = "own.x || coalesce('DECOMP ' || dec.x, '')" if shown else "own.x"
    plain_code = code().replace("code AS (", "calls AS (")
    return f"""WITH RECURSIVE {plain_code}, {_EXPANDED.replace("FROM code", "FROM calls")},
y AS (SELECT id, pc, k, op, args[1] AS a, args[2] AS b, args[3] AS c, args[2] AS lit FROM x),
code AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pc, k) - 1 AS INT) AS pc, op, a, b, c, lit, 0 AS t FROM y),
{VM},
own AS (SELECT id, pc, {line_ids(calls)} AS ids, {_CALL_TEXT} AS x FROM calls),
dec AS (SELECT y.id, y.pc, flatten(list({line_ids({n: isa.ID[n] for n in isa.BASE})} ORDER BY k)) AS ids, string_agg({_TEXT}, '' ORDER BY k) AS x FROM y SEMI JOIN (SELECT id, pc FROM m WHERE symbol IS NOT NULL) USING (id, pc) GROUP BY y.id, y.pc),
prog AS (SELECT own.id, flatten(list(own.ids ORDER BY own.pc)) AS bare, flatten(list({part} ORDER BY own.pc)) AS ids, string_agg(own.x, '' ORDER BY own.pc) AS bare_x, string_agg({text}, '' ORDER BY own.pc) AS x FROM own LEFT JOIN dec USING (id, pc) GROUP BY own.id),
told AS (SELECT o_custkey AS customer, prog.*, list_concat({number('output[1]')}, [{isa.ID['NEWLINE']}]) AS out, output[1] || chr(10) AS out_x, row_number() OVER (PARTITION BY o_custkey ORDER BY prog.id DESC) AS r
  FROM prog JOIN ended USING (id) JOIN orders ON o_orderkey = prog.id)
SELECT customer AS id, count(*) - 1 AS demos, '{isa.ID['BOS']},' || array_to_string(flatten(list(CASE WHEN r = 1 THEN bare ELSE list_concat(ids, out) END ORDER BY told.id)), ',') || ',{isa.ID['EOS']}' AS input_ids,
  '{isa.ID['BOS']},' || array_to_string(any_value(out) FILTER (r = 1), ',') || ',{isa.ID['EOS']}' AS target_ids, string_agg(CASE WHEN r = 1 THEN bare_x ELSE x || out_x END, '' ORDER BY told.id) AS input_text, any_value(out_x) FILTER (r = 1) AS target_text
FROM told GROUP BY customer"""


SPLIT = "'part_' || (id % 3)"

_INDEX = {"p25": "n // 4", "p50": "n // 2", "p75": "(3 * n) // 4", "p95": "least(n - 1, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT))", "p99": "least(n - 1, CAST(floor(CAST(0.99 AS DOUBLE) * n) AS BIGINT))"}

SUMMARY = machine(f""", {_LINES}, {_PROGRAMS},
texts AS (SELECT id, sum(length({_TEXT})) AS chars, count(*) AS n FROM code GROUP BY id),
m AS (SELECT {SPLIT} AS split, texts.n AS program_length, (SELECT count(*) FROM steps WHERE steps.id = e.id) AS trace_steps, len(output) AS output_len, len(ids) + 2 AS input_id_len,
  2 + list_sum(list_transform(output, lambda v: length(v::VARCHAR) + 1)) AS target_id_len, chars AS input_text_chars, list_sum(list_transform(output, lambda v: length(v::VARCHAR) + 1)) AS target_text_chars
  FROM ended e JOIN programs USING (id) JOIN texts USING (id)),
long AS (UNPIVOT (SELECT split, program_length::BIGINT AS program_length, trace_steps::BIGINT AS trace_steps, output_len::BIGINT AS output_len, input_id_len::BIGINT AS input_id_len, target_id_len::BIGINT AS target_id_len,
  input_text_chars::BIGINT AS input_text_chars, target_text_chars::BIGINT AS target_text_chars FROM m) ON COLUMNS(* EXCLUDE split) INTO NAME measure VALUE value),
sorted AS (SELECT split, measure, list_sort(list(value)) AS v, count(*) AS n, sum(value) / count(*) AS mean FROM long GROUP BY split, measure)
SELECT split, measure, n, v[1] AS min, {', '.join(f'v[{place} + 1] AS {q}' for q, place in _INDEX.items())}, v[n] AS max, mean FROM sorted""")

_SIGNED = f"""op_sets AS (SELECT id, count(DISTINCT op) AS n_opcodes FROM code GROUP BY id),
clamps AS (SELECT id, bool_or(list_max(regs) = {isa.HIGH} OR list_min(regs) = {isa.LOW}) AS clamping_seen FROM steps GROUP BY id),
sig AS (SELECT id, {SPLIT} AS split, n_opcodes, clamping_seen, output, list_bool_or(list_transform(output, lambda v: v <> 0)) AS output_nonzero, list_bool_or(list_transform(regs, lambda v: v <> 0)) AS last FROM ended JOIN op_sets USING (id) JOIN clamps USING (id))"""

_PREDICTED = """p AS (SELECT id, regs AS truth, list_transform(regs, lambda v, i: CASE WHEN i - 1 = id % 11 THEN v + 1 ELSE v END) AS changed FROM ended),
q AS (SELECT id, truth, CASE WHEN id % 5 = 0 THEN changed[1:6] ELSE changed END AS model FROM p),
pairs AS (SELECT id, CAST(i - 1 AS BIGINT) AS idx, CAST(truth[i] AS BIGINT) AS truth, CAST(model[i] AS BIGINT) AS model, i > len(model) OR truth[i] <> model[i] AS diverges FROM (SELECT *, unnest(range(1, 9)) AS i FROM q))"""

_BUNDLES = """b AS (SELECT id, CASE id % 13 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'schema' WHEN 2 THEN 'groundTruth.trace.halted' WHEN 3 THEN 'not an object' WHEN 7 THEN 'prediction' WHEN 8 THEN 'source' WHEN 9 THEN 'values' END AS problem,
  CASE id % 13 WHEN 4 THEN 'unparsed' WHEN 5 THEN 'mismatch' WHEN 6 THEN 'skipped' ELSE 'match' END AS parity, output[1] + (id % 13 = 5)::INT AS stored, output[1] + (id % 3 = 0)::INT AS told FROM ended),
c AS (SELECT id, problem, CASE WHEN problem IS NULL THEN parity END AS parity, CASE WHEN problem IS NULL THEN CASE WHEN stored = told THEN -1 ELSE 0 END::BIGINT END AS place,
  CASE WHEN problem IS NULL THEN CASE WHEN stored = told THEN 1.0 ELSE 0.0 END::DOUBLE END AS score FROM b)"""

_JUMP_TEXT = "'L' || pc || ':' || CASE WHEN op = 'LOAD' THEN 'LOAD R' || a || ' ' || lit WHEN op IN ('HALT', 'NOP') THEN op WHEN op = 'JMP' THEN 'JMP L' || t WHEN op = 'JZ' THEN 'JZ R' || a || ' L' || t WHEN op IN ('PUSH', 'POP', 'PRINT') THEN op || ' R' || a WHEN op IN ('MOV', 'NEG') THEN op || ' R' || a || ' R' || b ELSE op || ' R' || a || ' R' || b || ' R' || c END"


#: Dataflow over programs that jump forward only: one pass in order reaches the fixpoint. -1: control cannot come.
_FLOW = f"""prog AS (SELECT id, list({{'op': op, 'a': a, 't': t}} ORDER BY pc) AS code, CAST(count(*) AS INT) AS size FROM code GROUP BY id),
flow AS (SELECT id, 0 AS i, list_transform(range(size), lambda k: CASE WHEN k = 0 THEN 0 ELSE -1 END) AS masks, list_transform(range(size), lambda k: CASE WHEN k = 0 THEN 0 ELSE -1 END) AS depths FROM prog
  UNION ALL SELECT id, i + 1,
    CASE WHEN m < 0 THEN masks ELSE list_transform(masks, lambda v, k: CASE WHEN (op NOT IN ('HALT', 'JMP') AND k = i + 2) OR (op IN ('JZ', 'JMP') AND k = t + 1) THEN CASE WHEN v = -1 THEN m | w ELSE v & (m | w) END ELSE v END) END,
    CASE WHEN d < 0 THEN depths ELSE list_transform(depths, lambda v, k: CASE WHEN e < 0 AND k = i + 1 THEN e
      WHEN e >= 0 AND ((op NOT IN ('HALT', 'JMP') AND k = i + 2) OR (op IN ('JZ', 'JMP') AND k = t + 1)) THEN CASE WHEN v < -1 THEN v WHEN v = -1 OR v = e THEN e ELSE -4 END ELSE v END) END
  FROM (SELECT *, CASE WHEN d + delta < 0 THEN -2 WHEN d + delta > {isa.DEPTH} THEN -3 ELSE d + delta END AS e FROM (SELECT flow.*, code[i + 1].op AS op, code[i + 1].t AS t, masks[i + 1] AS m, depths[i + 1] AS d,
    CASE WHEN code[i + 1].op IN {tuple(isa.WRITING)} THEN 1 << code[i + 1].a ELSE 0 END AS w, CASE code[i + 1].op WHEN 'PUSH' THEN 1 WHEN 'POP' THEN -1 ELSE 0 END AS delta FROM flow JOIN prog USING (id) WHERE i < size))),
known AS (SELECT id, code, masks, depths FROM flow JOIN prog USING (id) WHERE i = size),
marks AS (SELECT id, unnest(range(len(code))) AS i, unnest(code) AS x, unnest(masks) AS m, unnest(depths) AS d FROM known),
told AS (SELECT id, string_agg('print of an unwritten register at ' || i, ';' ORDER BY i) FILTER (x.op = 'PRINT' AND NOT (m >= 0 AND m & (1 << x.a) <> 0)) AS prints,
  string_agg(CASE d WHEN -2 THEN 'stack underflow' WHEN -3 THEN 'stack overflow' ELSE 'stack depth differs between paths' END || ' at ' || i, ';' ORDER BY i) FILTER (d < -1) AS stack FROM marks GROUP BY id),
errors AS (SELECT id, prints IS NULL AND stack IS NULL AS valid, coalesce(prints, stack, '') AS errors FROM told)"""

_NUMBER = "CASE WHEN {0} % 2 = 0 THEN 10001 + {0} // 2 ELSE {0} END"
_LABELLED = f"""'L' || ({_NUMBER.format('pc')}) || ':' || CASE WHEN op = 'LOAD' THEN 'LOAD R' || a || CASE WHEN lit < 0 THEN '' ELSE ' ' END || lit WHEN op IN ('HALT', 'NOP') THEN op || ' ' WHEN op = 'JMP' THEN 'JMP L' || ({_NUMBER.format('t')})
  WHEN op = 'JZ' THEN 'JZ R' || a || ' L' || ({_NUMBER.format('t')}) WHEN op IN ('PUSH', 'POP', 'PRINT') THEN op || ' R' || a || ' ' WHEN op IN ('MOV', 'NEG') THEN op || ' R' || a || ' R' || b || ' ' ELSE op || ' R' || a || ' R' || b || ' R' || c || ' ' END || chr(10)"""

PROGRAM_JSON = machine(f""", {_LINES}, {_PROGRAMS},
p AS (SELECT id, list({{'op': op, 'args': CASE WHEN op = 'LOAD' THEN [a, lit] WHEN op IN {_THREE} THEN [a, b, c] WHEN op IN ('MOV', 'NEG') THEN [a, b] WHEN op = 'PRINT' THEN [a] ELSE [] END, 'label': NULL::VARCHAR, 'target': NULL::VARCHAR}} ORDER BY pc) AS program,
  string_agg({_TEXT}, '' ORDER BY pc) AS x, count(*) AS n FROM code GROUP BY id),
s AS (SELECT id, list({{'pc': pc, 'regs': regs, 'stack': stack, 'emitted': emitted}} ORDER BY t) AS steps FROM steps GROUP BY id)
SELECT to_json({{'meta': {{'tier': 'orders', 'split': {SPLIT}, 'bucket': NULL::VARCHAR, 'seed': id, 'axes': {{'n': n}}, 'renders': ['direct']}}, 'program': program, 'trace': {{'steps': s.steps, 'output': output, 'halted': true}},
  'renders': {{'direct': {{'input_ids': list_concat(list_concat([{isa.ID['BOS']}], ids), [{isa.ID['EOS']}]), 'target_ids': list_concat(list_concat([{isa.ID['BOS']}], {number('output[1]')}), [{isa.ID['NEWLINE']}, {isa.ID['EOS']}]), 'input_text': x, 'target_text': output[1] || chr(10)}}}}}})::VARCHAR AS value
FROM p JOIN s USING (id) JOIN ended USING (id) JOIN programs USING (id)""")


def oracle_sql() -> dict[str, str]:
    out = {f"alu_{op}": f"WITH {OPERANDS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, a, b, CAST({x} AS BIGINT) AS value FROM o" for op, x in ALU.items()}
    joined = _ARRAY.format
    out |= {
        "digits_encode": f"WITH {OPERANDS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, a, {joined(number('a'))} AS ids FROM o",
        "row_seed": f"WITH {SEEDED} SELECT id, seed FROM s",
        "counter_draws": f"WITH {SEEDED}, h AS (SELECT id, sha256(seed || '|t') AS h FROM s) SELECT id, " + ", ".join(f"{drawn('h', i)} % {m} AS d{i}" for i, m in enumerate((9, 8, 255, 1000))) + " FROM h",
        "alloc_registers": f"WITH {SEEDED} SELECT id, {joined(f'({_ORDER})[1:CAST(id % 8 + 1 AS INT)]')} AS registers FROM s",
        "gen_counter": GEN_COUNTER,
        "gen_register_trace": GEN_REGISTER,
        "vm_straightline_regs": machine(f"SELECT id, {joined('regs')} AS regs, status FROM ended"),
        "vm_output": machine("SELECT id, CAST(output[1] AS BIGINT) AS value FROM ended"),
        "vm_trace_long": machine(f"SELECT id, t, pc, {joined('regs')} AS regs, CAST(emitted AS BIGINT) AS emitted FROM steps"),
        "vm_forward_jumps": machine(f"SELECT e.id, status, {joined('regs')} AS regs, coalesce({joined('stack')}, '') AS stack, coalesce({joined('output')}, '') AS output, CAST(CASE WHEN status = 'halted' THEN t ELSE t - 1 END AS BIGINT) AS steps, status = 'halted' AS halted FROM ended e", True),
        "vm_stack_status": machine("SELECT status, count(*) AS n, CAST(sum(len(output)) AS BIGINT) AS printed FROM ended GROUP BY status", True),
        "vm_step_cap": f"WITH {code()} SELECT CASE WHEN n + 2 > 4 THEN 'step_cap' ELSE 'halted' END AS status, count(*) AS n FROM size GROUP BY 1",
        "encode_program": f"WITH {code()}, {_LINES}, {_PROGRAMS} SELECT id, {joined('ids')} AS ids FROM programs",
        "decode_roundtrip": "SELECT l_orderkey AS id, '' AS error FROM lineitem WHERE false",
        "render_direct": machine(f", {_LINES}, {_PROGRAMS} SELECT id, '{isa.ID['BOS']},' || {joined('ids')} || ',{isa.ID['EOS']}' AS input_ids, '{isa.ID['BOS']},' || {joined(number('output[1]'))} || ',{isa.ID['NEWLINE']},{isa.ID['EOS']}' AS target_ids FROM programs JOIN ended USING (id)"),
        "render_text": machine(f", texts AS (SELECT id, string_agg({_TEXT}, '' ORDER BY pc) AS input_text FROM code GROUP BY id) SELECT id, input_text, output[1] || chr(10) AS target_text FROM texts JOIN ended USING (id)"),
        "render_cot_full": cot(f"'{_REGS}"),
        "render_cot_modified": cot(_CHANGED),
        "render_probe": machine(f""", want AS (SELECT id, id % max(t + 1) AS t FROM steps GROUP BY id), here AS (SELECT id, pc, regs FROM steps JOIN want USING (id, t))
SELECT here.id, string_agg({_TEXT}, '' ORDER BY code.pc) || '? ' AS input_text, '{_REGS.replace('regs', 'any_value(regs)')} || chr(10) AS target_text FROM here JOIN code ON here.id = code.id AND code.pc <= here.pc GROUP BY here.id"""),
        "probe_targets": machine(f"SELECT id, t, {joined('regs')} AS regs FROM steps"),
        "decode_values": machine(f"SELECT id, coalesce({joined('output')}, '') AS numbers FROM ended", True),
        "score_exact": "SELECT DISTINCT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM lineitem",
        "macro_expand": f"WITH {code()}, {_EXPANDED} SELECT id, string_agg({_X_TEXT}, '' ORDER BY pc, k) AS text FROM x GROUP BY id",
        "macro_expand_rows": f"WITH {code()}, {_EXPANDED} SELECT id, CAST(pc AS BIGINT) AS pc, CAST(k AS BIGINT) AS k, op, coalesce({joined('args')}, '') AS args FROM x",
        "userop_render": f"WITH {code()}, lines AS (SELECT id, pc, {line_ids({n: isa.ID[n] for n in isa.BASE} | {'MOV': isa.ID['DOUBLE'], 'EQ': isa.ID['MAX'], 'NEG': isa.ID['ABS']})} AS ids FROM code), {_PROGRAMS} SELECT id, {joined('ids')} AS ids FROM programs",
        "userop_prompts": userops(False),
        "userop_prompts_decomposed": userops(True),
        "op_freq": f"WITH {code()} SELECT op, count(*) AS n FROM code GROUP BY op",
        "op_freq_totals": f"WITH {code()} SELECT split, op, count(*) AS n, CAST(grouping(split) AS BIGINT) AS is_total FROM (SELECT {SPLIT} AS split, op FROM code) GROUP BY GROUPING SETS ((split, op), (op))",
        "op_share": f"WITH {code()} SELECT bin, n, 100.0::DOUBLE * n / sum(n) OVER () AS percent FROM (SELECT CAST(CASE op {' '.join(f"WHEN '{n}' THEN {isa.OPS[n].code}" for n in isa.BASE)} END AS BIGINT) AS bin, count(*) AS n FROM code GROUP BY 1)",
        "register_writes": f"WITH {code()} SELECT split, register, n, n::DOUBLE / sum(n) OVER (PARTITION BY split) AS share FROM (SELECT {SPLIT} AS split, CAST(a AS BIGINT) AS register, count(*) AS n FROM code WHERE op IN {tuple(isa.FILL)} GROUP BY 1, 2)",
        "length_summary": SUMMARY,
        "first_lengths": f"WITH {code()} SELECT id, split, length, place FROM (SELECT id, {SPLIT} AS split, CAST(n + 2 AS BIGINT) AS length, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS place FROM size) WHERE place < 100",
        "output_hist": machine("SELECT bin, n, 100.0::DOUBLE * n / sum(n) OVER () AS percent FROM (SELECT CAST(floor(output[1] / 100) AS BIGINT) AS bin, count(*) AS n FROM ended GROUP BY 1)"),
        "distinct_outputs": machine(f"SELECT {SPLIT} AS split, count(DISTINCT output) AS outputs, count(*) AS programs FROM ended GROUP BY 1"),
        "jz_predecessor": f"WITH {code(True)}, b AS (SELECT op, lag(op) OVER (PARTITION BY id ORDER BY pc) AS before FROM code), c AS (SELECT before AS op, count(*) AS n FROM b WHERE op = 'JZ' AND before IS NOT NULL GROUP BY 1) SELECT op, n, n::DOUBLE / sum(n) OVER () AS share FROM c",
        "conditional_counts": f"WITH {code(True)}, f AS (SELECT bool_or(op = 'PUSH') AS s, bool_or(op = 'JZ') AS b FROM code GROUP BY id) SELECT count(*) FILTER (s AND b) AS stack_branch, 0::BIGINT AS stack_loop, 0::BIGINT AS branch_loop, 0::BIGINT AS all_three FROM f",
        "rebalanced": machine("SELECT bin, least(n, 20) AS n, 100.0::DOUBLE * least(n, 20) / sum(least(n, 20)) OVER () AS percent FROM (SELECT CAST(floor(output[1] / 100) AS BIGINT) AS bin, count(*) AS n FROM ended GROUP BY 1)"),
        "best_example": machine(f", {_SIGNED} SELECT split, id, n_opcodes, clamping_seen, output_nonzero FROM sig WHERE n_opcodes >= 4 QUALIFY row_number() OVER (PARTITION BY split ORDER BY output_nonzero DESC, last DESC, clamping_seen DESC, n_opcodes DESC, id) = 1"),
        "first_clamp": machine(f", {_SIGNED} SELECT split, id, {joined('output')} AS output FROM sig WHERE clamping_seen AND output_nonzero QUALIFY row_number() OVER (PARTITION BY split ORDER BY id) = 1"),
        "pick_with_fallback": machine(f""", {_SIGNED}, f AS (SELECT id % 997 AS part, id, n_opcodes, n_opcodes >= 5 AND n + 2 BETWEEN 6 AND 9 AS fits, output_nonzero, last, clamping_seen FROM sig JOIN size USING (id))
SELECT part, id, n_opcodes, NOT fits AS fallback FROM f QUALIFY row_number() OVER (PARTITION BY part ORDER BY fits DESC, fits AND output_nonzero DESC, fits AND last DESC, fits AND clamping_seen DESC, CASE WHEN fits THEN n_opcodes END DESC, id) = 1"""),
        "op_freq_documents": f"WITH {code()}, c AS (SELECT {SPLIT} AS split, op, count(*) AS n FROM code GROUP BY 1, 2) SELECT split, '{{' || string_agg('\"' || op || '\":' || n, ',' ORDER BY n DESC, op) || '}}' AS op_freq FROM c GROUP BY split",
        "sketched_totals": "SELECT measure, n, d AS distinct, true AS ok FROM (SELECT count(*) AS n, count(DISTINCT CAST(round(o_totalprice * 100) AS BIGINT)) AS d FROM orders), (SELECT unnest(['p25', 'p50', 'p75', 'p95', 'p99']) AS measure)",
        "file_order": "SELECT row_number() OVER () - 1 AS idx, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem",
        "first_in_files": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, o_custkey FROM orders QUALIFY idx < 2000",
        "packed_copy": "WITH l AS (SELECT l_orderkey AS id, count(*) + 1 AS n FROM lineitem GROUP BY 1) SELECT (o_custkey % 40)::VARCHAR AS bucket, count(*) AS n, sum(l.n)::BIGINT AS lines FROM l JOIN orders ON o_orderkey = id WHERE id % 5 = 0 AND o_custkey % 40 IN (SELECT c_custkey FROM customer WHERE c_custkey < 40 AND c_mktsegment = 'BUILDING') GROUP BY 1",
        "sql_lines": f"""WITH {code()}, w AS (SELECT id, op, CASE op WHEN 'LOAD' THEN [a, lit] WHEN 'PRINT' THEN [a] WHEN 'HALT' THEN [] ELSE [a, b] END AS args FROM code), v AS (SELECT id, op, args[1] * 300 - 900 AS a, args[2] - 3 AS b FROM w),
k AS (SELECT id, count(DISTINCT op) AS k FROM code GROUP BY id)
SELECT op, count(*) AS n, count(DISTINCT id) AS programs, sum(coalesce(CASE op WHEN 'LOAD' THEN {clamped('a')} WHEN 'MOV' THEN a WHEN 'ADD' THEN {clamped('a + b')} WHEN 'SUB' THEN {clamped('a - b')} WHEN 'MUL' THEN {clamped('a * b')}
  WHEN 'DIV' THEN CASE WHEN b = 0 THEN 0 ELSE {clamped('sign(a) * sign(b) * (abs(a) // abs(b))')} END WHEN 'NEG' THEN {clamped('-a')} WHEN 'EQ' THEN (a = b)::INT WHEN 'LT' THEN (a < b)::INT END, 0))::BIGINT AS total, max(k) AS most FROM v JOIN k USING (id) GROUP BY op""",
        "decode_programs": f"""WITH {code(True)}, x AS (SELECT id, string_agg({_JUMP_TEXT} || chr(10), '' ORDER BY pc) AS x FROM code GROUP BY id),
e AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'no NEWLINE at the end' WHEN id % 7 = 1 THEN 'bad line: PAD' WHEN id % 11 = 3 THEN 'unknown id' WHEN id % 13 = 4 THEN 'bad line: JZ R1' END AS error FROM x)
SELECT id, CASE WHEN error IS NULL THEN x END AS text, error FROM e""",
        "encode_labels": f"WITH {code(True)} SELECT id, string_agg({_LABELLED}, '' ORDER BY pc) AS text FROM code GROUP BY id",
        "program_json": PROGRAM_JSON,
        "replay_report": f"WITH {code()} SELECT id, id % 9 = 0 AS output_differs, (id % 10 = 0)::BIGINT AS steps_short FROM size WHERE id % 9 = 0 OR id % 10 = 0",
        "asm_duplicate_labels": f"WITH {code(True)} SELECT id, CASE WHEN id % 4 <> 0 THEN n + 1 END::BIGINT AS length, (n + k)::BIGINT AS line, CASE k WHEN 2 THEN 'label defined twice: L0' WHEN 3 THEN 'label defined twice: L1' END AS message FROM size, (SELECT unnest([0, 2, 3]) AS k) WHERE CASE WHEN id % 4 = 0 THEN k > 0 ELSE k = 0 END".replace("(n + k)::BIGINT AS line", "CASE WHEN k > 0 THEN n + k END::BIGINT AS line"),
        "program_errors": f"WITH RECURSIVE {code(True)}, {_FLOW} SELECT id, valid, errors FROM errors",
        "validate_programs": f"WITH RECURSIVE {code(True)}, {_FLOW} SELECT valid, CASE WHEN valid THEN 'none' ELSE regexp_replace(string_split(errors, ';')[1], ' at [0-9]+$', '') END AS kind, count(*) AS n FROM errors GROUP BY ALL",
        "golden_differences": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 1 THEN 'new' WHEN o_orderkey % 50 = 2 THEN 'length,output' ELSE 'output' END AS problem FROM orders WHERE o_orderkey % 50 IN (1, 2, 27)
UNION ALL SELECT -o_orderkey, 'missing' FROM orders WHERE o_orderkey % 50 = 3""",
        "zero_divisions": machine(f", b AS (SELECT s.id, s.pc, op, c, before FROM (SELECT *, {_BEFORE} AS before FROM steps) s JOIN code ON s.id = code.id AND s.pc = code.pc) SELECT id, string_agg(pc::VARCHAR, ',' ORDER BY pc) AS places FROM b WHERE op = 'DIV' AND before[c + 1] = 0 GROUP BY id"),
        "walk_program": machine(f"SELECT code.id, CAST(code.pc AS BIGINT) AS idx, op, CASE WHEN regs IS NOT NULL THEN {joined('regs')} END AS regs_after, CAST(emitted AS BIGINT) AS emitted FROM code LEFT JOIN steps ON code.id = steps.id AND code.pc = steps.pc", True),
        "print_write_check": f"WITH {code()}, m AS (SELECT id, pc, op, a, bit_or(CASE WHEN op IN {tuple(isa.FILL)} THEN 1 << a ELSE 0 END) OVER (PARTITION BY id ORDER BY pc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM code) SELECT id, CAST(pc AS BIGINT) AS pc, CAST(a AS BIGINT) AS a, (coalesce(seen, 0) & (1 << a)) <> 0 AS ok FROM m WHERE op = 'PRINT'",
        "stack_balance": f"WITH {code(True)}, d AS (SELECT id, pc, CASE op WHEN 'PUSH' THEN 1 WHEN 'POP' THEN -1 ELSE 0 END AS d FROM code), r AS (SELECT id, d, sum(d) OVER (PARTITION BY id ORDER BY pc) AS depth FROM d) SELECT id, CAST(min(depth) AS BIGINT) AS least, CAST(max(depth) AS BIGINT) AS most, CAST(sum(d) AS BIGINT) AS last, min(depth) >= 0 AND max(depth) <= {isa.DEPTH} AS ok FROM r GROUP BY id",
        "label_targets": f"WITH {code(True)} SELECT id, CAST(pc AS BIGINT) AS pc, 'L' || t AS target FROM code WHERE op IN ('JZ', 'JMP') AND t % 2 = 0",
        "divergence_rows": machine(f", {_PREDICTED} SELECT * FROM pairs"),
        "divergence_join": machine(f", {_PREDICTED} SELECT * FROM pairs"),
        "first_divergence": machine(f", {_PREDICTED} SELECT id, coalesce(min(idx) FILTER (diverges), -1) AS place, CASE WHEN bool_or(diverges) THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM pairs GROUP BY id"),
        "changed_register": machine(f", b AS (SELECT id, t, regs, {_BEFORE} AS before FROM steps) SELECT id, t, CAST(list_position(list_transform(range(1, 9), lambda r: regs[r] <> before[r]), true) - 1 AS BIGINT) AS register FROM b"),
        "stack_views": machine(f"SELECT id, t, coalesce({joined('list_reverse(stack)')}, '') AS top_down, CAST(len(stack) AS BIGINT) AS depth, len(stack)::DOUBLE / {isa.DEPTH} AS fill FROM steps", True),
        "file_digests": """WITH f AS (SELECT substr(o_orderpriority, 1, 1) AS bucket, (o_orderkey // 10000)::BIGINT AS chunk, count(*) AS rows,
  string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS x FROM orders GROUP BY 1, 2)
SELECT bucket, chunk, strlen(x)::BIGINT AS bytes, sha256(x) AS sha256, rows FROM f""",
        "bundle_parity": machine(f", {_BUNDLES} SELECT * FROM c"),
        "bundle_summary": machine(f", {_BUNDLES} SELECT problem, parity, count(*) AS n, sum(coalesce(score, 0))::DOUBLE AS right FROM c GROUP BY ALL"),
        "replay_mismatches": "SELECT l_orderkey AS id FROM lineitem WHERE false",
        "asm_parse_errors": "SELECT DISTINCT l_orderkey AS id, CAST(e.line AS BIGINT) AS line, e.message AS message FROM lineitem, (VALUES (2, 'unknown operation: FROB'), (3, 'not a register: R9')) e(line, message) WHERE l_orderkey % 7 = 0",
        "asm_lines": machine("SELECT id, t, pc, pc + 1 AS line FROM steps WHERE id % 7 <> 0", True),
        "asm_classes": f"""WITH {code(True)}, x AS (SELECT id, string_agg({_JUMP_TEXT}, ' ') AS s FROM code GROUP BY id),
w AS (SELECT unnest(regexp_extract_all(s, 'L[0-9]+:|[^ :]+')) AS word FROM x UNION ALL SELECT unnest(CASE WHEN id % 7 = 0 THEN ['; order', 'FROB', 'R1', 'ADD', 'R0', 'R9', 'R1'] ELSE [] END) FROM x)
SELECT CASE WHEN word[1] = ';' THEN 'comment' WHEN regexp_full_match(word, 'L[0-9]+:?') THEN 'label' WHEN regexp_full_match(word, 'R[0-7]') THEN 'register' WHEN regexp_full_match(word, '-?[0-9]+') THEN 'number' WHEN word IN {tuple(isa.BASE)} THEN 'operation' ELSE 'invalid' END AS class, count(*) AS n FROM w GROUP BY 1""",
    }
    return out

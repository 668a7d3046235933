"""Rewriting of SQL text to Spark SQL: parameters, statement splitting and the dialect's own spellings.

The rewriting works on tokens, never inside strings, quoted names or comments.
"""

from __future__ import annotations

import re

from tessera.errors import InvalidInputException
from tessera.types import split_top

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)"""
    r"""|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<param>\$[A-Za-z_0-9]+|\?)|(?P<op>::|//|->>|->|<=|>=|<>|!=|\|\||\*\*|[^\s])""",
    re.S,
)
_KIND = {"select": "SELECT", "from": "SELECT", "with": "SELECT", "values": "SELECT", "table": "SELECT", "pivot": "PIVOT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "create": "CREATE", "drop": "DROP", "alter": "ALTER", "copy": "COPY", "set": "SET", "pragma": "PRAGMA", "explain": "EXPLAIN", "describe": "DESCRIBE", "show": "SHOW", "begin": "TRANSACTION", "commit": "TRANSACTION", "rollback": "TRANSACTION", "call": "CALL", "prepare": "PREPARE", "attach": "ATTACH", "export": "EXPORT", "load": "LOAD", "use": "SET"}


def tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def tokenize(sql: str) -> list[tuple[int, str]]:
    """Position and kind of each token that isn't space."""
    return [(m.start(), m.lastgroup) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def statements(sql: str) -> list[str]:
    """The statements of a script."""
    parts, held = [], []
    for _, text in tokens(sql):
        if text == ";":
            parts.append("".join(held))
            held = []
        else:
            held.append(text)
    parts.append("".join(held))
    return [p.strip() for p in parts if any(k != "space" for k, _ in tokens(p))]


def kind(statement: str) -> str:
    first = next((t.lower() for k, t in tokens(statement) if k == "word"), "")
    return _KIND.get(first, first.upper())


def named_parameters(statement: str) -> list[str]:
    """Names of $name and numbers of $1 in order of first use; ? counts on."""
    out, count = [], 0
    for k, t in tokens(statement):
        if k == "param":
            count += t == "?"
            name = str(count) if t == "?" else t[1:]
            if name not in out:
                out.append(name)
    return out


def bind(statement: str, parameters) -> tuple[str, dict]:
    """The statement with :p_name markers, and the arguments of spark.sql for them."""
    wanted = named_parameters(statement)
    if isinstance(parameters, dict):
        given = {str(k): v for k, v in parameters.items()}
    else:
        given = {str(i + 1): v for i, v in enumerate(parameters or [])}
    if missing := [w for w in wanted if w not in given]:
        raise InvalidInputException(f"values are missing for parameters: {', '.join(missing)}")
    if excess := [g for g in given if g not in wanted]:
        raise InvalidInputException(f"values are given for parameters that aren't there: {', '.join(excess)}")
    out, count = [], 0
    for k, t in tokens(statement):
        if k == "param":
            count += t == "?"
            t = f":p_{count if t == '?' else t[1:]}"
        out.append(t)
    return "".join(out), {f"p_{k}": v for k, v in given.items()}


#: Function names of the dialect, and Spark's.
FUNCTIONS = {
    "list_value": "array", "list_pack": "array", "struct_pack": "named_struct", "list": "collect_list", "array_agg": "collect_list", "list_transform": "transform", "list_apply": "transform", "array_transform": "transform", "list_filter": "filter", "array_filter": "filter", "list_reduce": "reduce",
    "list_contains": "array_contains", "array_has": "array_contains", "list_has": "array_contains", "list_position": "array_position", "list_distinct": "array_distinct", "list_sort": "array_sort", "list_concat": "concat", "list_cat": "concat", "array_concat": "concat", "list_append": "array_append", "list_max": "array_max", "list_min": "array_min", "list_extract": "element_at", "array_extract": "element_at", "list_has_any": "arrays_overlap", "list_intersect": "array_intersect", "list_unique": "array_size",
    "len": "length", "strlen": "octet_length", "suffix": "endswith", "prefix": "startswith", "starts_with": "startswith", "ends_with": "endswith", "regexp_matches": "regexp_like", "string_split": "split", "str_split": "split", "string_to_array": "split", "regexp_split_to_array": "split", "array_to_string": "array_join", "list_aggr": "aggregate", "strpos": "instr", "position": "position", "ord": "ascii", "unicode": "ascii", "chr": "char",
    "arg_max": "max_by", "arg_min": "min_by", "max_by": "max_by", "min_by": "min_by", "quantile_cont": "percentile", "string_agg": "listagg", "group_concat": "listagg", "favg": "avg", "fsum": "sum", "sumkahan": "sum", "kahan_sum": "sum", "approx_quantile": "approx_percentile", "var": "var_samp", "stdev": "stddev_samp", "mean": "avg",
    "random": "rand", "today": "current_date", "strftime": "date_format", "epoch": "unix_timestamp", "date_part": "date_part", "datepart": "date_part", "isodow": "isodow", "dayofweek": "dayofweek", "from_base64": "unbase64", "to_base64": "base64", "sha256": "sha2", "json_extract_string": "get_json_object", "generate_series": "sequence", "gen_random_uuid": "uuid", "xor": "bitxor", "is_nan": "isnan", "isinf": "isinf", "trunc": "trunc", "typeof": "typeof", "map_extract": "element_at", "row": "struct", "ntile": "ntile",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _types(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """x::INTEGER[] and CAST(x AS HUGEINT) with Spark's type names."""
    out, i = [], 0
    plain = {"int", "bigint", "double", "float", "date", "string", "boolean", "decimal", "smallint", "tinyint"}
    names = {"hugeint": "decimal(38,0)", "uhugeint": "decimal(38,0)", "ubigint": "decimal(20,0)", "uinteger": "bigint", "usmallint": "int", "utinyint": "smallint", "varchar": "string", "text": "string", "blob": "binary", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "integer": "int", "int4": "int", "int8": "bigint", "real": "float", "bool": "boolean"}
    brackets: list[bool] = []  # of the open ones, which are a cast's
    before = ""
    while i < len(parts):
        k, t = parts[i]
        if k == "op" and t in "([":
            brackets.append(before in ("cast", "try_cast"))
        elif k == "op" and t in ")]" and brackets:
            brackets.pop()
        in_cast = before == "::" or before == "as" and bool(brackets) and brackets[-1]
        if k == "word" and in_cast and t.lower() in names.keys() | plain:
            own = names.get(t.lower(), t)
            while "".join(x for _, x in parts[i + 1 : i + 3]) == "[]":
                own, i = f"array<{own}>", i + 2
            out.append(("word", own))
        else:
            out.append((k, t))
        before = before if k == "space" else t.lower()
        i += 1
    return out


#: The marks of date formats, and Spark's letters.
_MARKS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%g": "SSS", "%%": "%"}


def _format(literal: str) -> str:
    """A date format of the dialect as Spark's."""
    parts = re.split(r"(%.)", literal.strip("'"))
    return "'" + "".join(_MARKS.get(x, x) if x.startswith("%") else re.sub(r"[A-Za-z]+", r"\\'\g<0>\\'", x) for x in parts) + "'"


def _lambda(text: str) -> str:
    """lambda a, b: ... as (a, b) -> ...; others as they are."""
    found = re.match(r"(?is)\s*lambda\s+([\w\s,]+?)\s*:(?!:)\s*(.*)", text)
    if not found:
        return text
    return f"({found[1]}) -> {found[2]}" if "," in found[1] else f"{found[1]} -> {found[2]}"


def _reduce(values: str, function: str, start: str | None = None) -> str:
    if start is not None:
        return f"aggregate({values}, {start}, {_lambda(function)})"
    return f"aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), element_at({values}, 1), {_lambda(function)})"


def _replace(text: str, pattern: str, by: str, options: str = "''") -> str:
    flags = options.strip().strip("'")
    if "i" in flags:
        pattern = f"concat('(?i)', {pattern})"
    if "g" in flags:
        return f"regexp_replace({text}, {pattern}, {by})"
    at, found = f"regexp_instr({text}, {pattern})", f"regexp_substr({text}, {pattern})"
    return f"(CASE WHEN {at} = 0 THEN {text} ELSE concat(substr({text}, 1, {at} - 1), regexp_replace({found}, {pattern}, {by}), substr({text}, {at} + length({found}))) END)"


def _date_diff(unit: str, begin: str, end: str) -> str:
    unit = unit.strip().strip("'").lower().rstrip("s")
    if unit == "day":
        return f"CAST(datediff(CAST({end} AS date), CAST({begin} AS date)) AS bigint)"
    if unit in ("year", "quarter", "month"):
        month = lambda x: f"(year({x}) * 12 + month({x}) - 1)"
        size = {"year": 12, "quarter": 3, "month": 1}[unit]
        return f"CAST(({month(end)} div {size}) - ({month(begin)} div {size}) AS bigint)"
    if unit in ("hour", "minute", "second"):
        size = {"hour": 3600, "minute": 60, "second": 1}[unit]
        start = lambda x: f"unix_timestamp(date_trunc('{unit}', {x}))"
        return f"CAST(({start(end)} - {start(begin)}) div {size} AS bigint)"
    raise InvalidInputException(f"date_diff by {unit} isn't known")


def _pack(*parts: str) -> str:
    pairs = [re.match(r"(?s)\s*(\"[^\"]+\"|`[^`]+`|\w+)\s*:=\s*(.*)", p) for p in parts]
    if not all(pairs):
        return f"named_struct({', '.join(parts)})"
    return "named_struct(" + ", ".join(f"'{p[1].strip(chr(34) + '`')}', {p[2]}" for p in pairs) + ")"


def _list(tail: str, value: str) -> str:
    """Nulls stay. An order or DISTINCT within is Spark's own affair."""
    if re.search(r"(?i)^\s*distinct\b|\border\s+by\b", value):
        return f"collect_list({value}){tail}"
    return f"transform(collect_list(struct({value} AS v)){tail}, x -> x.v)"


def _strftime(a: str, b: str) -> str:
    value, form = (b, a) if a.strip().startswith("'") else (a, b)
    return f"date_format({value}, {_format(form.strip())})"


#: Calls that take more than another name.
_CALLS = {
    "dayofweek": lambda x: f"(dayofweek({x}) - 1)",
    "isodow": lambda x: f"extract(DAYOFWEEK_ISO FROM {x})",
    "regexp_replace": _replace,
    "list_unique": lambda x: f"CAST(size(array_distinct(filter({x}, v -> v IS NOT NULL))) AS bigint)",
    "string_split": lambda x, by: f"split({x}, concat('\\\\Q', {by}, '\\\\E'))",
    "str_split": lambda x, by: f"split({x}, concat('\\\\Q', {by}, '\\\\E'))",
    "string_to_array": lambda x, by: f"split({x}, concat('\\\\Q', {by}, '\\\\E'))",
    "sha256": lambda x: f"sha2({x}, 256)",
    "trunc": lambda x: f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS double)",
    "isinf": lambda x: f"(abs({x}) = double('infinity'))",
    "xor": lambda a, b: f"({a} ^ {b})",
    "date_diff": _date_diff,
    "datediff": lambda *a: _date_diff(*a) if len(a) == 3 else f"datediff({', '.join(a)})",
    "strftime": _strftime,
    "strptime": lambda text, form: f"to_timestamp({text}, {_format(form.strip())})",
    "struct_pack": _pack,
    "unnest": lambda x: f"explode({x})",
    "list_transform": lambda x, f: f"transform({x}, {_lambda(f)})",
    "list_apply": lambda x, f: f"transform({x}, {_lambda(f)})",
    "array_transform": lambda x, f: f"transform({x}, {_lambda(f)})",
    "list_filter": lambda x, f: f"filter({x}, {_lambda(f)})",
    "array_filter": lambda x, f: f"filter({x}, {_lambda(f)})",
    "list_reduce": _reduce,
    "array_reduce": _reduce,
    "list_slice": lambda x, a, b: f"slice({x}, {a}, greatest({b} - {a} + 1, 0))",
    "array_slice": lambda x, a, b: f"slice({x}, {a}, greatest({b} - {a} + 1, 0))",
}
_AGGREGATES = {"list": _list, "array_agg": _list}
#: Words before a bracket or sign that aren't values.
_NOT_VALUES = frozenset("select from where and or not in on by having then else when case as between like limit values returning using is all distinct lambda div".split())


def _closing(parts: list[tuple[str, str]], at: int) -> int:
    """The place of the bracket that closes the one at a place."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for i in range(at, len(parts)):
        t = parts[i][1]
        if parts[i][0] == "op":
            depth += (t in pairs) - (t in pairs.values())
            if depth == 0:
                return i
    raise InvalidInputException("a bracket isn't closed")


def _arguments(parts: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out, depth = [[]], 0
    for k, t in parts:
        depth += (k == "op") * ((t in "([{") - (t in ")]}"))
        if t == "," and depth == 0 and not (out[-1] and next((x.lower() for kk, x in out[-1] if kk == "word"), "") == "lambda" and not any(x == ":" for _, x in out[-1])):
            out.append([])
        else:
            out[-1].append((k, t))
    return out if any(k != "space" for k, _ in out[0]) or len(out) > 1 else []


def _rewritten(parts: list[tuple[str, str]]) -> str:
    """Tokens of the dialect as Spark SQL: calls, lists, indices and slices (from 1), remainders (null by zero)."""
    out: list[str] = []
    value = -1  # place in out where the value before this token begins; -1: there is none
    dotted = modulo = False
    i = 0

    def put(text: str, is_value: bool) -> None:
        nonlocal value, dotted, modulo
        if is_value and modulo and not dotted:
            text, modulo = f"nullif({text}, 0)", False
        if is_value and not dotted:
            value = len(out)
        elif not is_value:
            value = -1
        dotted = False
        out.append(text)

    while i < len(parts):
        k, t = parts[i]
        low = t.lower()
        j = next((n for n in range(i + 1, len(parts)) if parts[n][0] != "space"), len(parts))
        after = parts[j][1] if j < len(parts) else ""
        if k == "space":
            out.append(t)
        elif k == "name":
            put(quoted(t[1:-1].replace('""', '"')) if t[0] == '"' else t, True)
        elif k == "string":
            put("'" + t[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'", True)
        elif t == "//":
            put(" div ", False)
        elif t == "%":
            put(t, False)
            modulo = True
        elif t == ".":
            out.append(t)
            dotted = True
            i += 1
            continue
        elif k == "word" and low == "exclude" and after == "(":
            put("EXCEPT", False)
        elif k == "word" and after == "(" and not dotted and (low in _CALLS or low in _AGGREGATES):
            end = _closing(parts, j)
            own = [_rewritten(a).strip() for a in _arguments(parts[j + 1 : end])]
            if low in _CALLS:
                try:
                    text = _CALLS[low](*own)
                except TypeError:
                    text = f"{FUNCTIONS.get(low, t)}({', '.join(own)})"
            else:
                tail = ""
                while True:
                    n = next((n for n in range(end + 1, len(parts)) if parts[n][0] != "space"), len(parts))
                    if n < len(parts) and parts[n][1].lower() in ("filter", "over"):
                        m = next((m for m in range(n + 1, len(parts)) if parts[m][0] != "space"), n)
                        stop = _closing(parts, m) if parts[m][1] == "(" else m
                        tail += f" {parts[n][1]} " + _rewritten(parts[m : stop + 1])
                        end = stop
                    else:
                        break
                text = _AGGREGATES[low](tail, ", ".join(own))
            put(text, True)
            i = end + 1
            continue
        elif k == "op" and t == "(":
            end = _closing(parts, i)
            inner = "(" + _rewritten(parts[i + 1 : end]) + ")"
            if value >= 0:
                out.append(inner)  # a call's arguments belong to its name
            else:
                put(inner, True)
            i = end + 1
            continue
        elif k == "op" and t == "[":
            end = _closing(parts, i)
            inside = parts[i + 1 : end]
            if value < 0:
                put("array(" + _rewritten(inside) + ")", True)
            else:
                depth, colon = 0, None
                for n, (kk, tt) in enumerate(inside):
                    depth += (kk == "op") * ((tt in "([") - (tt in ")]"))
                    if tt == ":" and depth == 0:
                        colon = n
                base = "".join(out[value:]).strip()
                if colon is not None:
                    lo, hi = _rewritten(inside[:colon]).strip() or "1", _rewritten(inside[colon + 1 :]).strip() or f"size({base})"
                    text = f"slice({base}, {lo}, greatest({hi} - {lo} + 1, 0))"
                elif len(inside) == 1 and inside[0][0] == "string":
                    text = f"{base}[{_rewritten(inside)}]"
                else:
                    text = f"try_element_at({base}, {_rewritten(inside).strip()})"
                del out[value:]
                out.append(text)
            i = end + 1
            continue
        elif k == "word":
            called = after == "(" and not dotted
            if called and low in FUNCTIONS:
                t = FUNCTIONS[low]
            if low in _NOT_VALUES and not dotted:
                put(t, False)
            elif modulo and called:
                end = _closing(parts, j)
                put(t + _rewritten(parts[j : end + 1]), True)
                i = end + 1
                continue
            else:
                put(t, True)
        elif k in ("number", "param"):
            put(t, True)
        else:
            put(t, False)
        i += 1
    return "".join(out)


def _alias(item: list[tuple[str, str]]) -> str | None:
    """The name that a column of a SELECT list has by AS, by a bare alias or by being a column; None for other expressions."""
    own = [x for x in item if x[0] != "space"]
    if not own or own[-1][0] not in ("word", "name"):
        return None
    lone = all(k in ("word", "name") or t == "." for k, t in own)
    return own[-1][1].strip('"`').lower() if lone or own[-2][0] != "op" or own[-2][1] in ")]" else None


def _selects_its_order(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A SELECT with ORDER BY and LIMIT that also selects what it is ordered by, in a query that takes it away again; others as they are."""
    at, depth = {}, 0  # the first place of each word that isn't in brackets
    for i, (k, t) in enumerate(parts):
        depth += (k == "op") * ((t in "([{") - (t in ")]}"))
        if k == "word" and depth == 0:
            at.setdefault(t.lower(), i)
    if next(iter(at), "") != "select" or not {"from", "order", "by", "limit"} <= at.keys() or at.keys() & {"distinct", "union", "except", "intersect", "qualify"}:
        return parts
    order = at["order"]
    by = next(i for i in range(order, len(parts)) if parts[i][1].lower() == "by")
    if not at["select"] < at["from"] < order < at["limit"]:
        return parts
    names = {_alias(c) for c in _arguments(parts[at["select"] + 1 : at["from"]])}
    items, more = [], []
    for item in _arguments(parts[by + 1 : at["limit"]]):
        end = len(item)
        while end and (item[end - 1][0] == "space" or item[end - 1][1].lower() in ("asc", "desc", "nulls", "first", "last")):
            end -= 1
        value, way = item[:end], item[end:]
        bare = [x for x in value if x[0] != "space"]
        if len(bare) == 1 and (bare[0][0] == "number" or bare[0][1].lower() == "all" or bare[0][0] in ("word", "name") and _alias(bare) in names):
            items.append(item)
        else:
            name = f"__order{len(more)}"
            more.append((name, value))
            items.append([("space", " "), ("word", name), ("space", " "), *way])
    if not more:
        return parts
    own = [*parts[: at["from"]]]
    while own[-1][0] == "space":
        own.pop()
    for name, value in more:
        own += [*tokens(", "), *value, *tokens(f" AS {name}")]
    own += [("space", " "), *parts[at["from"] : by + 1]]
    for i, item in enumerate(items):
        own += [*([("op", ",")] if i else []), *item]
    return [*tokens(f"SELECT * EXCLUDE ({', '.join(n for n, _ in more)}) FROM ("), *own, ("space", " "), *parts[at["limit"] :], ("op", ")")]


def _limited(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Queries in brackets that select what they are ordered by: of a correlated one with LIMIT that doesn't, Spark takes any rows."""
    out, i = [], 0
    while i < len(parts):
        out.append(parts[i])
        if parts[i] == ("op", "("):
            end = _closing(parts, i)
            out += [*_selects_its_order(_limited(parts[i + 1 : end])), parts[end]]
            i = end
        i += 1
    return out


def spark_sql(sql: str) -> str:
    """A statement of the dialect in Spark SQL."""
    parts = _limited(_types(tokens(sql)))
    text = _rewritten(parts)
    first = next((t.lower() for k, t in parts if k == "word"), "")
    if first == "from" and not re.search(r"(?i)\bselect\b", text):
        text = "SELECT * " + text
    text = _ordered(text)
    return _qualify(text)


def by_name(sql: str) -> tuple[list[str], list[bool]] | None:
    """The queries that UNION [ALL] BY NAME joins at the top of a statement, and which of the unions keep duplicates; None without such a union."""
    parts = tokens(sql)
    cuts, depth = [], 0
    words = [(i, t.lower()) for i, (k, t) in enumerate(parts) if k == "word"]
    at = dict((i, n) for n, (i, _) in enumerate(words))
    for i, (k, t) in enumerate(parts):
        depth += (k == "op") * ((t in "([") - (t in ")]"))
        if depth == 0 and i in at and t.lower() == "union":
            follow = [w for _, w in words[at[i] + 1 : at[i] + 4]]
            keep = follow[:1] == ["all"]
            if follow[keep : keep + 2] == ["by", "name"]:
                cuts.append((i, words[at[i] + 2 + keep][0] + 1, keep))
    if not cuts:
        return None
    begins, ends = [0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(parts)]
    return ["".join(t for _, t in parts[a:b]).strip() for a, b in zip(begins, ends)], [c[2] for c in cuts]


def expression(text: str) -> str:
    """An expression, or list of them, in Spark SQL."""
    return spark_sql(text)


def order_items(text: str) -> str:
    """An ORDER BY list where nulls come last unless it says otherwise."""
    out = []
    for item in split_top(text):
        if re.fullmatch(r"(?i)all(\s+(asc|desc))?", item) or re.search(r"(?i)\bnulls\s+(first|last)\s*$", item):
            out.append(item)
        else:
            out.append((item if re.search(r"(?i)\b(asc|desc)\s*$", item) else f"{item} ASC") + " NULLS LAST")
    return ", ".join(out)


_ORDER_END = re.compile(r"(?i)\b(rows|range|groups|limit|offset|union|except|intersect|fetch)\b")


def _ordered(text: str) -> str:
    """Null order for every ORDER BY of a text."""
    out, at = [], 0
    parts = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(parts):
        k, t, begin, end = parts[i]
        if k == "word" and t.lower() == "by" and re.search(r"(?i)\border\s*$", text[:begin]):
            depth, j = 0, i + 1
            while j < len(parts):
                kk, tt = parts[j][0], parts[j][1]
                if tt in "([":
                    depth += 1
                elif tt in ")]":
                    if depth == 0:
                        break
                    depth -= 1
                elif depth == 0 and (tt == ";" or kk == "word" and _ORDER_END.fullmatch(tt)):
                    break
                j += 1
            stop = parts[j][2] if j < len(parts) else len(text)
            items = text[end:stop]
            if not re.search(r"(?i)\border\s+by\b", items):
                out.append(text[at:end] + " " + order_items(items) + " ")
                at = stop
                i = j
                continue
        i += 1
    out.append(text[at:])
    return "".join(out)


def _qualify(text: str) -> str:
    """QUALIFY as a filter around the query."""
    depth = 0
    parts = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    for i, (k, t, begin, end) in enumerate(parts):
        depth += (t == "(") - (t == ")")
        if k == "word" and t.lower() == "qualify" and depth == 0:
            stop, inner = len(text), 0
            for kk, tt, at, _ in parts[i + 1 :]:
                inner += (tt == "(") - (tt == ")")
                if inner == 0 and kk == "word" and tt.lower() in ("order", "limit"):
                    stop = at
                    break
            head = re.sub(r"(?is)^\s*select\s+", "", text[:begin], count=1)
            at = next(p[2] for p in [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(head)] if p[1].lower() == "from")
            return f"SELECT * EXCEPT (__qualify) FROM (SELECT {head[:at].rstrip()}, ({text[end:stop].strip()}) AS __qualify {head[at:]}) WHERE __qualify {text[stop:]}"
    return text

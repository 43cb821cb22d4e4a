"""A small rule language, compiled to Spark columns.

A condition such as ``source_type == "article" and tags includes "finance"`` is read on the driver, checked against the
schema, and becomes one boolean Column; a set of rules becomes one projection that Catalyst optimises as a whole. The
language has no calls and no attribute access, so a rule can only compare fields with literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.lexicon import STOPWORDS
from corpusloom.functions.text import TEXTS, _udf, normalize, porter_stem, tokenize

# Limits of a rule.
MAX_CHARS, MAX_TOKENS, MAX_DEPTH, MAX_STRING, MAX_ITEMS, MAX_DIGITS, MAX_REGEX, MAX_REPEAT, MAX_ACTIONS = 4000, 1000, 32, 1000, 200, 40, 500, 100, 20
MAX_SUBJECT, MAX_ANCHORED = 20_000, 8000

WORDS = frozenset("and or not in includes contains mentions matches before after true false null".split())
COMPARE = frozenset("== != < <= > >= in includes contains mentions matches before after".split())
TOKEN = re.compile(
    r"""(?P<blank>\s+|\#[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<regex>/(?:[^/\\\n]|\\.)+/[a-z]*)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\],-])"""
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class RuleError(ValueError):
    """A rule that cannot be read or does not fit the schema; ``position`` is where."""

    def __init__(self, message: str, position: int = 0) -> None:
        super().__init__(message)
        self.position = position


def lex(source: str) -> list[tuple[str, object, int]]:
    """(kind, value, position) of each token, ending with ("end", None, n)."""
    if len(source) > MAX_CHARS:
        raise RuleError(f"The rule has {len(source)} characters; at most {MAX_CHARS} are allowed.", MAX_CHARS)
    out: list[tuple[str, object, int]] = []
    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise RuleError(f"Unexpected {source[at]!r}.", at)
        kind, raw = m.lastgroup, m.group()
        if kind == "string":
            value: object = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), raw[1:-1])
            if len(value) > MAX_STRING:
                raise RuleError("A text literal is too long.", at)
            out.append(("literal", value, at))
        elif kind == "number":
            if len(raw) > MAX_DIGITS:
                raise RuleError("A number has too many digits.", at)
            if m.end() < len(source) and source[m.end()] in "._" or re.match(r"[A-Za-z_]", source[m.end() : m.end() + 1]):
                raise RuleError("Malformed number.", at)
            out.append(("literal", float(raw) if re.search("[.eE]", raw) else int(raw), at))
        elif kind == "regex":
            pattern, flags = raw[1:].rsplit("/", 1)
            if set(flags) - set("ims"):
                raise RuleError(f"Unknown pattern flags {flags!r}.", at)
            pattern = pattern.replace("\\/", "/")
            check_regex(pattern, at)
            out.append(("regex", (pattern, flags), at))
        elif kind == "name":
            low = raw.lower()
            if low in ("true", "false", "null"):
                out.append(("literal", {"true": True, "false": False, "null": None}[low], at))
            elif low in WORDS:
                out.append(("word", low, at))
            elif raw.startswith("_") or "__" in raw:
                raise RuleError(f"The name {raw!r} is not allowed.", at)
            else:
                out.append(("field", raw, at))
        elif kind == "op":
            out.append(("op", raw, at))
        at = m.end()
        if len(out) > MAX_TOKENS:
            raise RuleError("The rule has too many parts.", at)
    return [*out, ("end", None, len(source))]


def check_regex(pattern: str, at: int = 0) -> None:
    """Refuse patterns that can take exponential time, and what only one of the regex engines knows."""
    if not pattern or len(pattern) > MAX_REGEX:
        raise RuleError("The pattern is empty or too long.", at)
    if re.search(r"\\[1-9]", pattern) or re.search(r"\(\?<?[=!]", pattern):
        raise RuleError("Patterns with backreferences or lookaround are not allowed.", at)
    if any(int(n) > MAX_REPEAT for m in re.finditer(r"\{(\d*),?(\d*)\}", pattern) for n in m.groups() if n):
        raise RuleError(f"The pattern repeats more than {MAX_REPEAT} times.", at)
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"Invalid pattern: {e}.", at) from None
    # groups, from the inside out: does one that repeats hold a repeat or alternatives?
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]", "x", pattern, flags=re.S)
    repeat = r"(?:[*+?]|\{\d*,?\d*\})"
    if re.search(rf"{repeat}(?:[*+]|\{{\d)", re.sub(rf"({repeat})[?+]", r"\1", bare)) and re.search(rf"(?:[*+]|\{{\d*,?\d*\}})(?:[*]|\{{\d)", bare):
        raise RuleError("The pattern stacks repeats.", at)
    depth = 0
    while m := re.search(r"\((?:\?[a-zA-Z:]+)?([^()]*)\)(" + repeat + r"[?+]?)?", bare):
        inner = re.search(rf"{repeat}|\||Q", m[1])
        if m[2] and inner:
            raise RuleError("The pattern repeats a group that itself repeats or has alternatives.", at)
        bare = bare[: m.start()] + ("Q" if m[2] or re.search(rf"{repeat}|Q", m[1]) else "x") + bare[m.end() :]
        depth += 1
        if depth > 200:
            raise RuleError("The pattern has too many groups.", at)


class Parser:
    """Tokens to a tree of tuples: (kind, ...)."""

    def __init__(self, source: str) -> None:
        self.tokens, self.k = lex(source), 0

    @property
    def now(self) -> tuple[str, object, int]:
        return self.tokens[self.k]

    def take(self, *values: str) -> bool:
        if self.now[0] in ("word", "op") and self.now[1] in values:
            self.k += 1
            return True
        return False

    def fail(self, what: str) -> RuleError:
        kind, value, at = self.now
        return RuleError(f"{what}, found {'the end' if kind == 'end' else repr(value)}.", at)

    def parse(self) -> tuple:
        tree = self.any_of(0)
        if self.now[0] != "end":
            raise self.fail("Expected the end of the rule")
        return tree

    def any_of(self, depth: int) -> tuple:
        parts = [self.all_of(depth)]
        while self.take("or"):
            parts.append(self.all_of(depth))
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def all_of(self, depth: int) -> tuple:
        parts = [self.negation(depth)]
        while self.take("and"):
            parts.append(self.negation(depth))
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def negation(self, depth: int) -> tuple:
        if depth > MAX_DEPTH:
            raise RuleError("The rule nests too deeply.", self.now[2])
        if self.take("not"):
            return "not", self.negation(depth + 1)
        left = self.primary(depth)
        op = self.operator()
        if not op:
            return left
        out = ("compare", op, left, self.primary(depth))
        if self.operator():
            self.k -= 1
            raise self.fail("A comparison cannot be chained")
        return out

    def operator(self) -> str | None:
        kind, value, _ = self.now
        if kind == "word" and value == "not" and self.tokens[self.k + 1][:2] == ("word", "in"):
            self.k += 2
            return "not in"
        if kind in ("word", "op") and value in COMPARE:
            self.k += 1
            return value
        return None

    def primary(self, depth: int) -> tuple:
        kind, value, at = self.now
        if self.take("("):
            inner = self.any_of(depth + 1)
            if not self.take(")"):
                raise self.fail("Expected )")
            return inner
        if self.take("["):
            items: list[tuple] = []
            while not self.take("]"):
                items.append(self.any_of(depth + 1))
                if len(items) > MAX_ITEMS:
                    raise RuleError("A list has too many items.", at)
                if not self.take(",") and self.now[:2] != ("op", "]"):
                    raise self.fail("Expected , or ]")
            return "list", tuple(items)
        if self.take("-"):
            kind, value, _ = self.now
            if kind != "literal" or isinstance(value, (str, bool)) or value is None:
                raise self.fail("Expected a number after -")
            self.k += 1
            return "literal", -value
        if kind in ("literal", "regex", "field"):
            self.k += 1
            return (kind, value)
        raise self.fail("Expected a value")


def parse(source: str) -> tuple:
    return Parser(source).parse()


def validate(source: str, schema: T.StructType | None = None) -> str | None:
    """The problem with a rule, or None."""
    try:
        tree = parse(source)
        if schema:
            compile_tree(tree, schema)
    except RuleError as e:
        return str(e)
    return None


def fields_used(tree: tuple) -> set[str]:
    if tree[0] == "field":
        return {tree[1]}
    parts = tree[2:] if tree[0] == "compare" else tree[1] if tree[0] == "list" else tree[1:] if tree[0] in ("and", "or", "not") else ()
    return set().union(*map(fields_used, parts)) if parts else set()


SAID = {"==": "is", "!=": "is not", "<": "is less than", "<=": "is at most", ">": "is more than", ">=": "is at least", "in": "is one of", "not in": "is none of", "includes": "includes", "contains": "contains", "mentions": "mentions", "matches": "matches", "before": "is before", "after": "is after"}


def describe(tree: tuple) -> str:
    """A rule in English."""
    kind = tree[0]
    if kind in ("and", "or"):
        return f" {kind} ".join(f"({describe(t)})" if t[0] in ("and", "or") else describe(t) for t in tree[1:])
    if kind == "not":
        return f"not ({describe(tree[1])})"
    if kind == "compare":
        return f"{describe(tree[2])} {SAID[tree[1]]} {describe(tree[3])}"
    if kind == "list":
        return ", ".join(map(describe, tree[1]))
    if kind == "regex":
        return f"/{tree[1][0]}/{tree[1][1]}"
    if kind == "literal":
        return {True: "yes", False: "no", None: "nothing"}.get(tree[1], repr(tree[1])) if not isinstance(tree[1], (int, float)) or isinstance(tree[1], bool) else str(tree[1])
    return tree[1].replace("_", " ")


# --- Compiling -----------------------------------------------------------------------------------------------------

NUMERIC = (T.IntegralType, T.FractionalType)
stem_tokens = _udf(lambda t: [porter_stem(w) for w in tokenize(t)], TEXTS)
folded = _udf(lambda t: None if t is None else normalize(t).casefold(), T.StringType())


@dataclass
class Value:
    """A compiled operand: its column, its type, and its value if it is a literal."""

    col: Column
    type: T.DataType
    literal: object = None
    known: bool = False
    items: list = field(default_factory=list)

    @property
    def text(self) -> Column:
        if isinstance(self.type, T.ArrayType):
            return F.array_join(self.col, " ")
        return F.coalesce(self.col.cast("string"), F.lit(""))

    @property
    def plain(self) -> Column:
        """Folded for comparing: case and width do not count. ASCII fields take the JVM path by ``ascii_only``."""
        if self.known and isinstance(self.literal, str):
            return F.lit(normalize(self.literal).casefold())
        return folded(self.text)


class Compiler:
    """Trees to columns over one schema. ascii_only: text fields fold by ``lower`` on the JVM instead of an Arrow UDF."""

    def __init__(self, schema: T.StructType, ascii_only: bool = False) -> None:
        self.fields = {f.name.lower(): f for f in schema.fields}
        self.ascii_only = ascii_only

    def value(self, tree: tuple) -> Value:
        if tree[0] == "field":
            f = self.fields.get(tree[1].lower())
            if f is None:
                near = [n for n in sorted(self.fields) if n.startswith(tree[1].lower()[:3])] or sorted(self.fields)
                raise RuleError(f"Unknown field {tree[1]!r}. Available fields: {', '.join(near[:8])}.")
            return Value(F.col(f"`{f.name}`"), f.dataType)
        if tree[0] == "literal":
            v = tree[1]
            kind = T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
            return Value(F.lit(v), kind, v, True)
        if tree[0] == "list":
            items = [self.value(t) for t in tree[1]]
            return Value(F.array(*(i.col.cast("string") for i in items)), T.ArrayType(T.StringType()), None, False, items)
        if tree[0] == "regex":
            raise RuleError("A pattern stands only on the right of 'matches'.")
        return Value(self.test(tree), T.BooleanType())

    def fold(self, v: Value) -> Column:
        return F.lower(F.trim(F.regexp_replace(v.text, r"\s+", " "))) if self.ascii_only and not v.known else v.plain

    def test(self, tree: tuple) -> Column:
        """A boolean column that is never null."""
        kind = tree[0]
        if kind == "and":
            return reduce(lambda a, b: a & b, map(self.test, tree[1:]))
        if kind == "or":
            return reduce(lambda a, b: a | b, map(self.test, tree[1:]))
        if kind == "not":
            return ~self.test(tree[1])
        if kind == "compare":
            return F.coalesce(self.compare(*tree[1:]), F.lit(False))
        v = self.value(tree)
        if isinstance(v.type, T.BooleanType):
            return F.coalesce(v.col, F.lit(False))
        if isinstance(v.type, NUMERIC):
            return F.coalesce(v.col != 0, F.lit(False))
        if isinstance(v.type, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(v.col) > 0, F.lit(False))
        return F.coalesce(F.trim(v.col.cast("string")) != "", F.lit(False))

    def compare(self, op: str, left: tuple, right: tuple) -> Column:
        if op == "matches":
            return self.matches(self.value(left), right)
        a, b = self.value(left), self.value(right)
        if op in ("==", "!="):
            same = F.coalesce(self.equal(a, b), F.lit(False))
            return same if op == "==" else ~same
        if op in ("<", "<=", ">", ">="):
            x, y = self.number(a, op), self.number(b, op)
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op in ("in", "not in"):
            inside = F.coalesce(self.member(a, b), F.lit(False))
            return inside if op == "in" else ~inside
        if op == "includes":
            return self.member(b, a)
        if op == "contains":
            return self.member(b, a) if isinstance(a.type, (T.ArrayType, T.MapType)) else self.within(b, a)
        if op == "mentions":
            return self.mentions(a, b)
        x, y = self.instant(a, op), self.instant(b, op)
        return x < y if op == "before" else x > y

    def equal(self, a: Value, b: Value) -> Column:
        if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
            return a.col.isNull() & b.col.isNull()
        if isinstance(a.type, T.BooleanType) or isinstance(b.type, T.BooleanType):
            other = b if isinstance(a.type, T.BooleanType) else a
            return a.col.cast("double") == b.col.cast("double") if isinstance(other.type, (T.BooleanType, *NUMERIC)) else F.lit(False)
        if isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
            return self.fold(a) == self.fold(b)
        if isinstance(a.type, (T.StringType, *NUMERIC)) and isinstance(b.type, (T.StringType, *NUMERIC)):
            return a.col.try_cast("double") == b.col.try_cast("double")
        if isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType):
            low = lambda v: F.transform(v.col, lambda x: F.lower(x.cast("string")))
            return low(a) == low(b)
        return a.col.cast("string") == b.col.cast("string")

    def number(self, v: Value, op: str) -> Column:
        """Numbers, truths as 0 and 1, numeric text, and the length of collections."""
        if isinstance(v.type, (T.ArrayType, T.MapType)):
            return F.size(v.col).cast("double")
        if isinstance(v.type, (T.BooleanType, *NUMERIC)):
            return v.col.cast("double")
        if v.known and (v.literal is None or not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", str(v.literal))):
            raise RuleError(f"Cannot compare {v.literal!r} with '{op}': it is not a number.")
        return F.trim(v.col.cast("string")).try_cast("double")

    def member(self, needle: Value, hay: Value) -> Column:
        if hay.items:
            return reduce(lambda x, y: x | y, (F.coalesce(self.equal(needle, i), F.lit(False)) for i in hay.items))
        if isinstance(hay.type, T.StringType):
            return self.within(needle, hay)
        if isinstance(hay.type, (T.ArrayType, T.MapType)):
            values = hay.col if isinstance(hay.type, T.ArrayType) else F.map_keys(hay.col)
            want = F.lit(normalize(str(needle.literal)).casefold()) if needle.known else F.lower(needle.text)
            return F.exists(values, lambda x: F.lower(x.cast("string")) == want)
        return self.equal(needle, hay)

    def within(self, needle: Value, hay: Value) -> Column:
        want = self.fold(needle)
        return (want != "") & F.contains(self.fold(hay), want)

    def mentions(self, hay: Value, needle: Value) -> Column:
        if not needle.known:
            raise RuleError("'mentions' needs a text on the right.")
        words = tokenize(str(needle.literal))
        content = [w for w in words if w not in STOPWORDS] if len(words) > 1 else words
        phrase = " ".join(map(porter_stem, content or words))
        return F.contains(F.concat(F.lit(" "), F.array_join(stem_tokens(hay.text), " "), F.lit(" ")), F.lit(f" {phrase} ")) if phrase else F.lit(False)

    def matches(self, subject: Value, right: tuple) -> Column:
        if right[0] != "regex":
            raise RuleError("'matches' needs a /pattern/ on the right.")
        pattern, flags = right[1]
        anchored = re.search(r"\\[AZz]|(?<!\\)[\^$]", re.sub(r"\[(?:\\.|[^\]])*\]", "x", pattern))
        return F.substring(subject.text, 1, MAX_ANCHORED if anchored else MAX_SUBJECT).rlike((f"(?{flags})" if flags else "") + pattern)

    def instant(self, v: Value, op: str) -> Column:
        if v.known:
            t = F.to_timestamp(F.lit(v.literal)) if isinstance(v.literal, str) and re.match(r"\s*\d{4}-\d{2}-\d{2}", v.literal) else F.timestamp_seconds(F.lit(v.literal)) if isinstance(v.literal, (int, float)) and not isinstance(v.literal, bool) else None
            if t is None:
                raise RuleError(f"{v.literal!r} is not a date; '{op}' takes one like 2024-01-31.")
            return t
        if isinstance(v.type, NUMERIC):
            return F.timestamp_seconds(v.col)
        if isinstance(v.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return v.col.cast("timestamp")
        if not isinstance(v.type, T.StringType):
            raise RuleError(f"A value of type {v.type.simpleString()} is not a date.")
        return F.try_to_timestamp(F.trim(v.col))


def compile_tree(tree: tuple, schema: T.StructType, ascii_only: bool = False) -> Column:
    return Compiler(schema, ascii_only).test(tree)


def condition(source: str, schema: T.StructType, ascii_only: bool = False) -> Column:
    """A rule's text as a boolean Column over rows of the schema."""
    return compile_tree(parse(source), schema, ascii_only)


# What each action needs and may have.
ACTIONS = {
    "tag": ({"value"}, set()), "email": ({"subject"}, {"to", "body", "include_summary"}), "webhook": ({"url"}, {"method", "payload", "headers"}), "extract_numbers": (set(), {"into", "units"}),
    "add_to_timeline": (set(), {"label", "date_field"}), "archive": (set(), {"reason"}), "pin": (set(), set()), "note": ({"text"}, set()),
}


def validate_actions(actions: object) -> list[str]:
    """Problems with a rule's actions. Webhooks must be https and must not point at this host or a private one."""
    if not isinstance(actions, list) or not actions or len(actions) > MAX_ACTIONS:
        return [f"Actions must be a list of 1 to {MAX_ACTIONS}."]
    out = []
    for k, a in enumerate(actions, 1):
        if not isinstance(a, dict) or a.get("type") not in ACTIONS:
            out.append(f"Action {k} has an unknown type.")
            continue
        need, may = ACTIONS[a["type"]]
        out += [f"Action {k} lacks {n!r}." for n in sorted(need) if not str(a.get(n) or "").strip()]
        out += [f"Action {k} has an unknown {n!r}." for n in sorted(set(a) - need - may - {"type"})]
        if a["type"] == "webhook" and not re.match(r"https://(?!localhost|127\.|0\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|\[)[^/\s]+", str(a.get("url", "")), re.I):
            out.append(f"Action {k} needs a public https address.")
    return out


def run_rules(rows: DataFrame, rules: list[dict], trigger: str, keep: tuple[str, ...] = ("id",), ascii_only: bool = False) -> DataFrame:
    """One row per row and rule: matched, error, explain and the actions' types. Rules: id, name, trigger, condition, actions, enabled.

    All conditions are columns of one projection over one scan; a rule that does not compile yields its error in every row.
    """
    outcomes = []
    for r in rules:
        test, error, explain = F.lit(False), None, ""
        if not r.get("enabled", True):
            explain = "The rule is disabled."
        elif r.get("trigger", "*") not in ("*", trigger):
            explain = f"The rule is for {r['trigger']}."
        else:
            try:
                tree = parse(r["condition"])
                test, explain = compile_tree(tree, rows.schema, ascii_only), describe(tree)
                error = "; ".join(validate_actions(r.get("actions") or [])) or None
            except RuleError as e:
                error = str(e)
        matched = test if error is None else F.lit(False)
        types = F.array(*(F.lit(a["type"]) for a in r.get("actions", []))) if r.get("actions") and error is None else F.array().cast("array<string>")
        outcomes.append(F.struct(F.lit(r["id"]).cast("long").alias("rule_id"), F.lit(r.get("name", "")).alias("rule_name"), matched.alias("matched"), F.lit(error).cast("string").alias("error"), F.lit(explain).alias("explain"), F.when(matched, types).otherwise(F.array().cast("array<string>")).alias("actions")))
    return rows.select(*keep, F.explode(F.array(*outcomes)).alias("r")).select(*keep, "r.*")


def apply_actions(entries: DataFrame, outcomes: DataFrame, rules: list[dict], by: str = "id") -> DataFrame:
    """Entries with tags added, archived and pinned as the matching rules say."""
    hits = outcomes.where("matched").select(by, "rule_id")
    values = [(r["id"], a["type"], str(a.get("value", ""))) for r in rules for a in r.get("actions", [])]
    acts = entries.sparkSession.createDataFrame(values, "rule_id long, type string, value string")
    done = hits.join(F.broadcast(acts), "rule_id").groupBy(by).agg(F.array_sort(F.collect_set(F.when(F.col("type") == "tag", F.lower("value")))).alias("_tags"), F.bool_or(F.col("type") == "archive").alias("_arch"), F.bool_or(F.col("type") == "pin").alias("_pin"))
    old = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    out = entries.join(done, by, "left")
    tags = F.array_join(F.slice(F.array_distinct(F.concat(old, "_tags")), 1, 25), ", ")
    flag = lambda name, have: F.when(F.coalesce(have, F.lit(False)), F.lit(True)).otherwise(F.col(name)).alias(name)
    names = [F.when(F.size("_tags") > 0, tags).otherwise(F.col("tags")).alias("tags") if c == "tags" else flag(c, F.col("_arch")) if c == "is_archived" else flag(c, F.col("_pin")) if c == "is_pinned" else F.col(c) for c in entries.columns]
    return out.select(*names)

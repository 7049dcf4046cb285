"""Chat formatting by a small compiled template language.

A template is text with ``{{ expression }}``, ``{% statement %}`` and
``{# comment #}``.  Statements: ``for x in e``, ``if e`` / ``elif e`` / ``else``,
``set x = e`` and ``generation``, each block closed by ``end...``; a ``-`` inside
a tag strips the white space beside it.  Expressions: literals, names, ``a.b``
and ``a['b']``, ``not and or``, comparisons, ``+``, ``~`` (text concatenation),
``in``, filters ``e | f`` and ``a if c else b``.  There are no calls, no
attributes of Python objects and no names beyond those given, so a template
cannot reach outside its data.

``compile_template`` parses into a syntax tree, folds constant expressions and
adjacent text, and turns the tree into Python closures.  Rendering yields pieces
with a flag that says whether a piece lies in a ``generation`` block, and takes
its messages from an iterator, so a conversation of any length is rendered turn
by turn and cut into parts of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Strings that control the format; texts hold them only in escaped form.
CONTROLS = ("<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = (
    "{%- for m in messages -%}"
    "{{ '<|turn|>' ~ (m.role | escape) ~ '<|body|>' }}"
    "{%- if m.role == 'assistant' -%}"
    "{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}"
    "{%- else -%}{{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}{%- endif -%}"
    "{{ '<|end|>' }}"
    "{%- endfor -%}"
)

#: Characters of one part of a formatted conversation.
PART_CHARS = 4_000_000

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    r"""Reversible: ``\`` is doubled and a control string gets a ``\`` after its first character.

    No control string's first character occurs inside another, so none survives
    or arises where escaped text meets the template's own.
    """
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
}


def _text(v: Any) -> str:
    if v is None:
        return ""
    if v is True or v is False:
        return "true" if v else "false"
    return v if isinstance(v, str) else str(v)


_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[<>+~|.()\[\],=-]))")
_STRING = {"n": "\n", "t": "\t", "r": "\r"}


def _split(source: str) -> list[tuple[str, str]]:
    """``(kind, body)`` runs: text, expression or statement; tags trim their neighbours."""
    out: list[tuple[str, str]] = []
    at, trim = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            return out
        close = {"{": "}}", "%": "%}", "#": "#}"}[m[0][1]]
        end, quote = m.end(), None
        while end < len(source) and (quote or not source.startswith(close, end)):
            c = source[end]
            if m[0][1] != "#":
                if quote and c == "\\":
                    end += 1
                elif c == quote:
                    quote = None
                elif not quote and c in "'\"":
                    quote = c
            end += 1
        if end >= len(source):
            raise TemplateError(f"unclosed {m[0]}")
        body = source[m.end() : end]
        trim = body.endswith("-")
        if m[0][1] != "#":
            out.append(("expr" if m[0][1] == "{" else "stmt", body[:-1] if trim else body))
        at = end + 2


class _Parser:
    """Recursive descent over one tag's tokens; nodes are tuples."""

    LEVELS = (("or",), ("and",))

    def __init__(self, body: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        while body[at:].strip():
            m = _TOKEN.match(body, at)
            if not m:
                raise TemplateError(f"cannot read {body[at:]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("value", int(m[1])))
            elif m[2]:
                self.tokens.append(("name", m[2]))
            elif m[3]:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda x: _STRING.get(x[1], x[1]), m[3][1:-1], flags=re.S)))
            else:
                self.tokens.append(("op", m[4]))
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *want: Any) -> Any:
        kind, value = self.peek()
        if want and (kind == "value" or value not in want):
            raise TemplateError(f"expected {' or '.join(want)}, found {value!r}")
        self.at += 1
        return value

    def word(self, *names: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "op") and value in names:
            self.at += 1
            return value
        return None

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        node = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.binary(0)
        if self.word("if"):
            test = self.binary(0)
            self.take("else")
            node = ("choice", test, node, self.choice())
        return node

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.negation()
        node = self.binary(level + 1)
        while op := self.word(*self.LEVELS[level]):
            node = (op, node, self.binary(level + 1))
        return node

    def negation(self) -> tuple:
        if self.word("not"):
            return ("not", self.negation())
        node = self.joined()
        while op := self.word("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("compare", op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.word("+", "~", "-"):
            node = ("join", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while True:
            if self.word("|"):
                f = self.name()
                if f not in FILTERS:
                    raise TemplateError(f"no filter {f!r}")
                node = ("filter", f, node)
            elif self.word("."):
                node = ("item", node, ("value", self.name()))
            elif self.word("["):
                node = ("item", node, self.choice())
                self.take("]")
            else:
                return node

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "value":
            return ("value", value)
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("value", fixed[value]) if value in fixed else ("name", value)
        if value == "(":
            node = self.choice()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree: ('block', [nodes])."""
    runs = _split(source)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, _Parser | None]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(runs):
            kind, body = runs[at]
            at += 1
            if kind == "text":
                nodes.append(("out", ("value", body)))
            elif kind == "expr":
                nodes.append(("out", _Parser(body).whole()))
            else:
                p = _Parser(body)
                word = p.name()
                if word in ends:
                    return ("block", nodes), word, p
                nodes.append(statement(word, p))
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return ("block", nodes), "", None

    def statement(word: str, p: _Parser) -> tuple:
        if word == "set":
            name = p.name()
            p.take("=")
            return ("set", name, p.whole())
        if word == "for":
            name = p.name()
            p.take("in")
            return ("for", name, p.whole(), block(("endfor",))[0])
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        if word == "if":
            branches, test = [], p.whole()
            while True:
                body, end, p2 = block(("elif", "else", "endif"))
                branches.append((test, body))
                if end == "endif":
                    return ("if", branches)
                test = p2.whole() if end == "elif" else ("value", True)
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


def _apply(node: tuple) -> Any:
    """The value of a node whose operands are all values."""
    return _expression(node)({})


def fold(node: Any) -> Any:
    """Replaces constant expressions by values, drops dead branches, joins adjacent text."""
    if isinstance(node, list):
        return [fold(n) for n in node]
    if not isinstance(node, tuple) or not node or node[0] in ("value", "name"):
        return node
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for n in fold(node[1]):
            parts = n[1] if n[0] == "block" else [n]
            for part in parts:
                if part[0] == "out" and part[1][0] == "value" and out and out[-1][0] == "out" and out[-1][1][0] == "value":
                    out[-1] = ("out", ("value", _text(out[-1][1][1]) + _text(part[1][1])))
                else:
                    out.append(part)
        return ("block", out)
    if kind == "if":
        kept = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "value" and not test[1]:
                continue
            kept.append((test, fold(body)))
            if test[0] == "value":
                break
        if kept and kept[0][0][0] == "value":
            return kept[0][1]
        return ("if", kept) if kept else ("block", [])
    if kind in ("out", "set", "for", "generation"):
        return tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    node = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    operands = [x for x in node[1:] if isinstance(x, tuple)]
    if operands and all(x[0] == "value" for x in operands):
        try:
            return ("value", _apply(node))
        except TemplateError:
            return node  # raised when it is rendered, if it is
    return node


def _item(base: Any, key: Any) -> Any:
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return base[key] if -len(base) <= key < len(base) else None
    return None


_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def _expression(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "item":
        a, b = _expression(node[1]), _expression(node[2])
        return lambda env: _item(a(env), b(env))
    if kind == "filter":
        f, a = FILTERS[node[1]], _expression(node[2])
        return lambda env: _checked(lambda: f(a(env)))
    if kind == "join":
        a, b = _expression(node[2]), _expression(node[3])
        if node[1] == "~":
            return lambda env: _text(a(env)) + _text(b(env))
        return (lambda env: _checked(lambda: a(env) + b(env))) if node[1] == "+" else (lambda env: _checked(lambda: a(env) - b(env)))
    if kind == "compare":
        f, a, b = _COMPARE[node[1]], _expression(node[2]), _expression(node[3])
        return lambda env: _checked(lambda: f(a(env), b(env)))
    if kind == "not":
        a = _expression(node[1])
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = _expression(node[1]), _expression(node[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    a, b, c = (_expression(x) for x in node[1:])
    return lambda env: b(env) if a(env) else c(env)


def _checked(run: Callable[[], Any]) -> Any:
    try:
        return run()
    except TypeError as e:
        raise TemplateError(str(e)) from None


Pieces = Iterator[tuple[str, bool]]


def _statement(node: tuple) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "out":
        if node[1][0] == "value":
            fixed = _text(node[1][1])

            def run(env, mask):
                yield fixed, mask

            return run
        value = _expression(node[1])

        def run(env, mask):
            yield _text(value(env)), mask

        return run
    if kind == "set":
        name, value = node[1], _expression(node[2])

        def run(env, mask):
            env[name] = value(env)
            return iter(())

        return run
    if kind == "generation":
        body = _statement(node[1])
        return lambda env, mask: body(env, True)
    if kind == "if":
        branches = [(_expression(t), _statement(b)) for t, b in node[1]]

        def run(env, mask):
            for test, body in branches:
                if test(env):
                    return body(env, mask)
            return iter(())

        return run
    if kind == "for":
        name, items, body = node[1], _expression(node[2]), _statement(node[3])

        def run(env, mask):
            seen = None
            it = iter(items(env) or ())
            ahead = next(it, run)
            k = 0
            while ahead is not run:
                seen, ahead = ahead, next(it, run)
                inner = env | {name: seen, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is run}}
                yield from body(inner, mask)
                k += 1

        return run
    parts = [_statement(n) for n in node[1]]

    def run(env, mask):
        for p in parts:
            yield from p(env, mask)

    return run


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A renderer: given the names a template may use, it yields (text, in generation)."""
    body = _statement(fold(parse(source)))
    return lambda env: body(dict(env), False)


def _rows(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in cols), strict=True)


FORMATTED = "conv_id bigint, part int, last boolean, text string, spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per part of a conversation: its text and the spans of its loss mask.

    Rows are put in the order of turn (then role and text, so ties are settled
    by content) by one shuffle on conv_id and a sort; a task streams through its
    conversations and holds one part.  Null roles and texts are empty, rows with
    a null conv_id form one conversation, repeated rows are turns of their own,
    extra columns are ignored.
    """
    src = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)
        rows = _rows(batches, ["conv_id", "role", "text"])
        row = next(rows, None)
        out: list[tuple] = []
        size = 0
        while row is not None:
            conv = row[0]

            def messages():
                nonlocal row
                while row is not None and row[0] == conv:
                    m = {"role": row[1], "text": row[2]}
                    row = next(rows, None)
                    yield m

            pieces, spans, n, part = [], [], 0, 0
            for text, mask in render({"messages": messages()}):
                if n and n + len(text) > part_chars:
                    out.append((conv, part, False, "".join(pieces), spans))
                    size += n
                    pieces, spans, n, part = [], [], 0, part + 1
                    if size >= part_chars:
                        yield _formatted(out)
                        out, size = [], 0
                if mask and text:
                    spans.append({"start": n, "end": n + len(text)})
                pieces.append(text)
                n += len(text)
            for _ in messages():  # turns that the template left unread
                pass
            out.append((conv, part, True, "".join(pieces), spans))
            size += n
            if size >= part_chars or len(out) >= 1000:
                yield _formatted(out)
                out, size = [], 0
        if out:
            yield _formatted(out)

    return ordered.mapInArrow(run, FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), span]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "part", "last", "text", "spans"])


class TurnReader:
    """Reads turns back out of the default template's output, part by part."""

    TURN = re.compile(re.escape("<|turn|>") + "(.*?)" + re.escape("<|body|>") + "(.*?)" + re.escape("<|end|>"), re.S)

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        text = self.rest + text
        at = 0
        for m in self.TURN.finditer(text):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            body = m[2]
            if body.startswith("[INST] ") and body.endswith(" [/INST]"):
                body = body[len("[INST] ") : -len(" [/INST]")]
            elif body.endswith("</s>"):
                body = body[: -len("</s>")]
            else:
                raise ValueError("a turn without its marks")
            yield unescape(m[1]), unescape(body)
        self.rest = text[at:]


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame, clustered: bool = False) -> DataFrame:
    """Digests of each conversation, read from its formatted parts.

    ``clustered`` says that a partition holds whole conversations, part by part
    in order, as format_conversations leaves them; else one shuffle sees to it.
    """
    src = formatted if clustered else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        out, state = [], None
        for conv, last, text, spans in _rows(batches, ["conv_id", "last", "text", "spans"]):
            if state is None:
                state = [TurnReader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in state[0].feed(text):
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
            for s in spans:
                loss = unescape(text[s["start"] : s["end"]])
                state[3] += len(loss)
                state[4].update(loss.encode())
            state[5] += len(text)
            if last:
                if state[0].rest:
                    raise ValueError("an unfinished turn")
                out.append((conv, state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                state = None
                if len(out) >= 1000:
                    yield _digests(out)
                    out = []
        if out:
            yield _digests(out)

    return src.mapInArrow(run, READ)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)), clustered=True)


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace(role, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(role, '<\|turn\|>|<\|body\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS r,
    length(replace(text, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(text, '<\|turn\|>|<\|body\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS b
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(r + b + 8 + 8 + 7 + CASE WHEN role = 'assistant' THEN 4 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

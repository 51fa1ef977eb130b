"""Chat formatting by compiled templates (operator 8).

A template in a small sandboxed language is parsed into a syntax tree,
constants are folded, and the tree becomes nested Python closures. The
language has text, ``{{ expression }}``, ``{% for m in messages %}``,
``{% if %} / {% elif %} / {% else %}`` and ``{% generation %}`` blocks, whose
output is under the loss mask. Expressions know strings, numbers, names,
fields of a message, comparisons, ``and / or / not``, joining with ``~`` and the
filters below: there are no calls and no Python attributes.

Conversations are rendered turn by turn from a stream sorted by
conversation and turn, so that a task holds one turn at a time, however
long the conversation is. Each turn gives a piece: its text and the spans
under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distillery.llm.shared import col

# Strings that chat formats use for control
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' }}{{ m.role | escape_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{% endfor %}"
)

_STARTS = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
_CONTROL = re.compile(rf"\\|{_STARTS}")
_LINE = re.compile(rf"\\|\n|{_STARTS}")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(s: str) -> str:
    """Break every control string with a backslash after its first sign;
    backslashes are doubled, so that ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", s)


def escape_line(s: str) -> str:
    """``escape`` for a text that must stay on one line."""
    return _LINE.sub(lambda m: "\\\\" if m[0] == "\\" else "\\n" if m[0] == "\n" else m[0] + "\\", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def unescape_line(s: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], s)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "lower": str.lower,
                                "upper": str.upper, "length": len}


class TemplateError(ValueError):
    """The template is not in the language."""


# --- syntax tree: tuples whose first entry names the node -------------------

_MARK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[~+<>.|()\[\]]))""", re.DOTALL)
_SIGNS = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("string", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def either(self) -> tuple:
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        e = self.joined()
        op = self.take("==", "!=", "<", ">", "<=", ">=", "in")
        return ("compare", op, e, self.joined()) if op else e

    def joined(self) -> tuple:
        e = self.filtered()
        while op := self.take("~", "+"):
            e = ("join" if op == "~" else "add", e, self.filtered())
        return e

    def filtered(self) -> tuple:
        e = self.primary()
        while op := self.take(".", "[", "|"):
            if op == "[":
                e = ("field", e, self.either())
                if not self.take("]"):
                    raise TemplateError("missing ]")
                continue
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name":
                raise TemplateError(f"a name must follow {op!r}")
            self.at += 1
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e) if op == "|" else ("field", e, ("const", name))
        return e

    def primary(self) -> tuple:
        if self.take("("):
            e = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return e
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _SIGNS.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _MARK.finditer(source):
        parts += [("text", source[at: m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", source[at:]))
    body, rest = _block(parts, 0, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return body


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    found = []
    while at < len(parts):
        kind, s = parts[at]
        word = s.split(None, 1)[0] if kind == "tag" and s else ""
        if kind == "tag" and word in ends:
            return ("block", *found), at
        at += 1
        if kind == "text":
            found.append(("text", s))
        elif kind == "out":
            found.append(("out", _Expression(s).whole()))
        elif word == "generation":
            body, at = _block(parts, at, ("endgeneration",))
            found.append(("generation", body))
            at = _past(parts, at)
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", s)
            if not m:
                raise TemplateError("loops run over messages")
            body, at = _block(parts, at, ("endfor",))
            found.append(("for", m[1], body))
            at = _past(parts, at)
        elif word == "if":
            node, at = _branches(parts, at, s[2:])
            found.append(node)
        else:
            raise TemplateError(f"no tag {s!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return ("block", *found), at


def _branches(parts: list, at: int, test: str) -> tuple[tuple, int]:
    yes, at = _block(parts, at, ("elif", "else", "endif"))
    no: tuple = ("block",)
    if at < len(parts):
        tag = parts[at][1]
        if tag.startswith("elif"):
            node, at = _branches(parts, at + 1, tag[4:])
            return ("if", _Expression(test).whole(), yes, ("block", node)), at
        if tag == "else":
            no, at = _block(parts, at + 1, ("endif",))
    return ("if", _Expression(test).whole(), yes, no), _past(parts, at)


def _past(parts: list, at: int) -> int:
    if at >= len(parts):
        raise TemplateError("a block is not closed")
    return at + 1


# --- folding and closures ----------------------------------------------------

_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
            "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}


def _text(v) -> str:
    return "" if v is None else str(v)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, dead branches dropped
    and neighbouring texts joined."""
    kind = node[0]
    if kind in ("text", "const", "name"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for n in map(fold, node[1:]):
            for x in n[1:] if n[0] == "block" else (n,):
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", *out)
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
    if kind == "out":
        return ("text", _text(parts[0][1])) if parts[0][0] == "const" else ("out", parts[0])
    if kind == "if":
        return (parts[1] if parts[0][1] else parts[2]) if parts[0][0] == "const" else (kind, *parts)
    if kind in ("for", "generation"):
        return (kind, *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _value((kind, *parts))({}))
    return (kind, *parts)


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda ctx, v=node[1]: v
    if kind == "name":
        return lambda ctx, k=node[1]: ctx.get(k)
    if kind == "field":
        of, key = _value(node[1]), _value(node[2])

        def field(ctx):
            v, k = of(ctx), key(ctx)
            return v.get(k) if isinstance(v, dict) else None
        return field
    if kind == "filter":
        f, of = FILTERS[node[1]], _value(node[2])
        return lambda ctx: f(_text(of(ctx)))
    if kind == "not":
        of = _value(node[1])
        return lambda ctx: not of(ctx)
    if kind == "compare":
        op, a, b = _COMPARE[node[1]], _value(node[2]), _value(node[3])
        return lambda ctx: op(a(ctx), b(ctx))
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if kind == "or":
        return lambda ctx: a(ctx) or b(ctx)
    if kind == "join":
        return lambda ctx: _text(a(ctx)) + _text(b(ctx))
    return lambda ctx: a(ctx) + b(ctx)


class _Piece:
    """Text as it is made, with the spans under the loss mask."""

    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.masked = 0

    def add(self, s: str) -> None:
        if s:
            if self.masked:
                if self.spans and self.spans[-1][1] == self.size:
                    self.spans[-1] = (self.spans[-1][0], self.size + len(s))
                else:
                    self.spans.append((self.size, self.size + len(s)))
            self.text.append(s)
            self.size += len(s)


# A compiled node runs as a generator: it adds to the open piece and yields
# at the end of each turn of an outer loop.
_Runner = Callable[[dict, _Piece], Iterator[None]]


def _runner(node: tuple) -> _Runner:
    kind = node[0]
    if kind == "text":
        def run(ctx, piece, s=node[1]):
            piece.add(s)
            yield from ()
        return run
    if kind == "out":
        value = _value(node[1])

        def run(ctx, piece):
            piece.add(_text(value(ctx)))
            yield from ()
        return run
    if kind == "block":
        parts = [_runner(n) for n in node[1:]]

        def run(ctx, piece):
            for p in parts:
                yield from p(ctx, piece)
        return run
    if kind == "generation":
        inner = _runner(node[1])

        def run(ctx, piece):
            piece.masked += 1
            yield from inner(ctx, piece)
            piece.masked -= 1
        return run
    if kind == "if":
        test, yes, no = _value(node[1]), _runner(node[2]), _runner(node[3])

        def run(ctx, piece):
            yield from (yes if test(ctx) else no)(ctx, piece)
        return run
    name, body = node[1], _runner(node[2])

    def run(ctx, piece):
        messages = iter(ctx["messages"])
        m, i = next(messages, None), 0
        while m is not None:
            following = next(messages, None)
            loop = {"index0": i, "index": i + 1, "first": i == 0, "last": following is None}
            yield from body({**ctx, name: m, "loop": loop}, piece)
            yield
            m, i = following, i + 1
    return run


class Template:
    """A compiled template. ``pieces(messages)`` takes any iterable of
    ``{"role", "text"}`` and yields ``(text, spans under the loss mask)`` turn
    by turn; ``messages`` is read once, so it has one loop."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        if str(self.tree).count("('for', ") > 1:
            raise TemplateError("messages can be run over once")
        self._run = _runner(self.tree)

    def pieces(self, messages) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        piece = _Piece()
        for _ in self._run({"messages": messages}, piece):
            yield "".join(piece.text), piece.spans
            masked = piece.masked
            piece.__init__()
            piece.masked = masked
        if piece.size:
            yield "".join(piece.text), piece.spans

    def render(self, messages) -> tuple[str, list[tuple[int, int]]]:
        text, spans, size = [], [], 0
        for s, own in self.pieces(messages):
            spans += [(a + size, b + size) for a, b in own]
            text.append(s)
            size += len(s)
        return "".join(text), spans


# --- Spark -------------------------------------------------------------------

_PIECES = "conv_id bigint, piece bigint, formatted string, loss_start array<int>, loss_end array<int>"


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows with the same first entry, as nested streams."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``(conv_id, piece, formatted, loss_start, loss_end)``: the pieces of
    each conversation in order; joined by ``piece`` they are its whole text.

    Turns go by number, then role and text; null numbers come first, null
    texts and roles are empty, null ids form one conversation; repeated rows
    are turns of their own; an empty table gives no pieces; other columns
    are not read. The template is checked here, before any task runs.
    """
    Template(template)
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()),
                        ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)

        def pieces():
            for conv, turns in _runs(_rows(batches)):
                messages = ({"role": r or "", "text": t or ""} for _, r, t in turns)
                for k, (s, spans) in enumerate(compiled.pieces(messages)):
                    yield conv, k, s, [a for a, _ in spans], [b for _, b in spans]
        return _batches(pieces(), schema)

    rows = df.select(col("conv_id").cast("bigint").alias("conv_id"), col("turn").alias("turn"), col("role").alias("role"),
                     col("text").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(render, _PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their pieces alone: turns are
    found by their marks, the loss text by its spans."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests():
            for conv, own in _runs(_rows(batches)):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                left = ""
                for _, s, starts, ends in own:
                    chars += len(s)
                    for a, b in zip(starts, ends, strict=True):
                        plain = unescape(s[a:b])
                        loss_chars += len(plain)
                        loss.update(plain.encode("utf-8", "surrogatepass"))
                    *whole, left = (left + s).split(END + "\n")
                    for t in whole:
                        role, text = t.split(TURN, 1)[1].split("\n", 1)
                        turns.update(f"{unescape_line(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
        return _batches(digests(), schema)

    kind = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(read, kind)

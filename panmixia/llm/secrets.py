"""Secrets: fixed patterns, and literals that reach a sensitive name through assignments."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from panmixia.llm.common import slices, strings, trimmed

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so a longer pattern and a later filter are the same

# Parts of names, and how much each says that the value is a secret.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "private": 2, "auth": 2, "bearer": 2, "key": 1, "access": 1, "api": 1, "signing": 1, "db": 0.5, "user": -1, "public": -2, "id": -1, "name": -2, "path": -2, "url": -1, "file": -2, "count": -3, "length": -3, "max": -3, "min": -3, "type": -2}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|none|null|nil|true|false|undefined|todo|your[_-].*|<.*>|\$\{.*\}|%\(.*)$")

_TOKENS = re.compile(
    r"(?P<string>(?:(?<![\w$])[bfruBFRU]{1,2})?(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
    r"|\"(?:[^\"\\\n]|\\.)*+\"|(?<!\w)'(?:[^'\\\n]|\\.)*+'(?!\w)|(?:(?<=(?<![\w$])[bfruBFRU])|(?<=(?<![\w$])[bfruBFRU]{2}))'(?:[^'\\\n]|\\.)*+\'|`[^`\n]*+`))"
    r"|(?P<word>[A-Za-z_$][\w$]*+(?:[.\-][\w$]++)*+)"
    r"|(?P<tag><[A-Za-z_][\w.:\-]*+)"
    r"|(?P<line>\n[\x20\t]*+)"
    r"|(?P<op>:=|=>|[=!<>]=|::|\.\.+|[=:+(){}\[\],;|>]|[0-9]++|[^\s\w])", re.A | re.S)  # fmt: skip
SETS = {"=", ":=", "=>", ":"}
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>#]++")
# an annotation's brackets, if a value follows
_ANNOTATED = re.compile(r"\[[^\]\n=]*+\]++[\x20\t]*+(?==(?!=))")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>(?P<value>[^<>]++)</(?P=name)\s*+>", re.A)
_TAG = re.compile(r"<[^<>]*+>")
_ATTRIBUTE = re.compile(r"""(?<![\w.:\-])([\w.:\-]++)\s*+=\s*+("[^"<>]*+"|'[^'<>]*+')""", re.A)
_KEY = re.compile(r"[A-Za-z_$][\w$.\-\x20]*+\Z", re.A)
_DOTTED = re.compile(r"[A-Za-z_$]++(?:\.[A-Za-z_$]++)*+\Z", re.A)
# signs around a secret that are words themselves: the lines of a PEM key, and the scheme of an authorization
FRAME = re.compile(r"-----(?:BEGIN|END)[A-Z0-9\x20]*-----|^(?:bearer|basic|token)\x20+", re.I | re.A)
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Words of prose, which a passphrase does without.
PROSE = frozenset("a an and are as be by can enter for from if in is it must new no not of on or our please should that the this to type use was with you your".split())


def sensitivity(name: str) -> float:
    """What the parts of a name say together; camel case, dots, dashes and underscores separate them."""
    return sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0)) for p in map(str.lower, _PIECES.findall(name))) + 3 * ("apikey" in name.lower().replace("_", "") and "Key" not in name)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(told: float, value: str) -> float:
    """Over 0: a secret. A telling name, a value of 6 signs or more that is neither prose nor a stand-in."""
    value = FRAME.sub("", value).strip()
    if told <= 0 or len(value) < 6 or PLACEHOLDERS.match(value):
        return -1.0
    if re.search(r"\s", value) and FRAME.sub("", value) == value and "\n" not in value:
        # a passphrase: some words, none of prose, none that ends a sentence
        words = value.split()
        if told < 3 or not 3 <= len(words) <= 24 or any(w.lower() in PROSE or w[-1] in ".,;:!?" for w in words):
            return -1.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]"))
    return told + 0.5 * mixed + min(entropy(value), 4.5) / 1.5 - 4.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind; those that fail are dropped."""
    found, low = [], text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class _Lexer:
    """Tokens of source and configuration texts, one at a time: (kind, start, end)."""

    def __init__(self, text: str):
        self.text, self.at, self.held = text, 0, None

    def peek(self) -> tuple[str, int, int]:
        if self.held is None:
            m = _TOKENS.search(self.text, self.at)
            self.held = (m.lastgroup, m.start(), m.end()) if m else ("end", len(self.text), len(self.text))
        return self.held

    def next(self) -> tuple[str, int, int]:
        token = self.peek()
        self.at, self.held = token[2], None
        return token

    def back(self, at: int) -> None:
        self.at, self.held = at, None

    def said(self, token: tuple[str, int, int]) -> str:
        return self.text[token[1] : token[2]]


class _Value:
    """What a name is bound to: own literals, and the values of other names in it, which are not copied."""

    __slots__ = ("spans", "others", "told")

    def __init__(self):
        self.spans, self.others, self.told = [], [], False

    def parts(self) -> list[_Value]:
        """Itself and all values in it, but for what is in values that have been told."""
        out, seen, stack = [], {id(self)}, [self]
        while stack:
            v = stack.pop()
            out.append(v)
            if not v.told:
                stack += [o for o in reversed(v.others) if id(o) not in seen]
                seen.update(map(id, v.others))
        return out


class _Parser:
    """One pass over the tokens: binds names to values, hands constants on, and reports literals of sensitive names.

    Keys of nested mappings, by indentation or by braces, add to the names inside.
    """

    def __init__(self, text: str):
        self.text, self.lexer = text, _Lexer(text)
        self.bound: dict[str, _Value] = {}
        self.found: set[tuple[int, int]] = set()
        self.scopes: list[tuple[str, int, str, float]] = []  # (bracket or "indent", column of its key, key, sensitivity with those around)
        self.indent, self.fresh = 0, True

    def run(self) -> set[tuple[int, int]]:
        lexer = self.lexer
        while (token := lexer.next())[0] != "end":
            kind, start, end = token
            if kind == "line":
                self.indent, self.fresh = end - start - 1, True
                continue
            if self.fresh:
                while self.scopes and self.scopes[-1][0] == "indent" and self.scopes[-1][1] >= self.indent:
                    self.scopes.pop()
            if kind in ("word", "string"):
                self._name(token)
            elif kind == "tag":
                self._tag(start)
            elif kind == "op":
                self._bracket(lexer.said(token))
            # a dash before a list's key is part of its indentation
            self.fresh = self.fresh and kind == "op" and lexer.said(token) == "-"
        return self.found

    def _bracket(self, said: str, key: str = "") -> None:
        if said in ("{", "["):
            self._scope(said, key)
        elif said in ("}", "]"):
            opening = "{" if said == "}" else "["
            for i in range(len(self.scopes) - 1, -1, -1):
                if self.scopes[i][0] != "indent":
                    if self.scopes[i][0] == opening:
                        del self.scopes[i:]
                    break

    def _content(self, token: tuple[str, int, int]) -> tuple[int, int]:
        said = self.text[token[1] : token[2]]
        at = next(i for i, c in enumerate(said) if c in "\"'`")
        marks = 3 if said[at : at + 3] in ('"""', "'''") and len(said) >= at + 6 else 1
        return token[1] + at + marks, token[2] - marks

    def _scope(self, bracket: str, key: str) -> None:
        around = self.scopes[-1][3] if self.scopes else 0.0
        self.scopes.append((bracket, self.indent, key, around + sensitivity(key)))

    def _tell(self, name: str, value: _Value) -> None:
        told = sensitivity(name)
        if told >= 0 and self.scopes:
            told += self.scopes[-1][3]  # a name that is harmless by itself stays so under any key
        if value.told or told <= 0:
            return
        parts = value.parts()
        spans = [s for v in parts if not v.told for s in v.spans if s[1] > s[0]]
        # what a known secret is a part of is one
        if any(v.told for v in parts) or spans and literal_score(told, "".join(self.text[a:z] for a, z in dict.fromkeys(spans))) > 0:
            self.found.update(spans)
            for v in parts:
                v.told = True

    def _literal(self, name: str, start: int, end: int) -> None:
        value = _Value()
        while start < end and self.text[start].isspace():
            start += 1
        while end > start and self.text[end - 1].isspace():
            end -= 1
        value.spans.append((start, end))
        self._tell(name, value)

    def _tag(self, start: int) -> None:
        """An element's text under its name, and pairs of a key and a value among its attributes; others are plain assignments."""
        if m := _ELEMENT.match(self.text, start):
            self._literal(m["name"], m.start("value"), m.end("value"))
        if tag := _TAG.match(self.text, start):
            given = {m[1].lower(): (m.start(2) + 1, m.end(2) - 1) for m in _ATTRIBUTE.finditer(self.text, start, tag.end())}
            name = next((given[k] for k in ("key", "name", "id") if k in given), None)
            if name and "value" in given:
                self._literal(self.text[slice(*name)], *given["value"])

    def _name(self, token: tuple[str, int, int]) -> None:
        lexer = self.lexer
        follows = lexer.peek()
        name = lexer.said(token) if token[0] == "word" else self.text[slice(*self._content(token))]
        if follows[0] == "op" and lexer.said(follows) in SETS and (token[0] == "word" or len(name) < 200 and _KEY.match(name)):
            first = self.fresh
            self.fresh = False
            self._assignment(name, first)
        elif token[0] == "string" and self.scopes and self.scopes[-1][0] == "[" and self.scopes[-1][2]:
            self._literal("", *self._content(token))  # an item of a list under a key

    def _assignment(self, name: str, first: bool) -> None:
        """From the sign behind ``name`` on: further targets, then a value, which may be a sum over several lines."""
        lexer, targets, value = self.lexer, [name], _Value()
        sign = lexer.said(lexer.next())
        depth, parts, opaque = 0, 0, False
        bare = None
        while True:
            token = lexer.peek()
            kind, said = token[0], lexer.said(token)
            if kind == "line" and (depth or self.text[token[1] - 1] in "\\" or self.text[token[1] - 2 : token[1]] == "\\\r" or parts):
                lexer.next()
            elif said == "\\" and self.text[token[2] : token[2] + 2].lstrip("\r")[:1] == "\n":
                lexer.next()
            elif said == "(" and not parts:
                lexer.next()
                depth += 1
            elif not parts and kind == "line":
                if sign == ":" and first and len(targets) == 1:
                    self._scope("indent", name)
                break
            elif not parts and said in ("{", "["):
                lexer.next()
                self._bracket(said, name)
                break
            elif not parts and sign == ":" and said in ("|", ">") and first:
                self._block(name, token[2])
                break
            elif kind == "string":
                lexer.next()
                value.spans.append(self._content(token))
                parts += 1
                if not self._goes_on(depth, True):
                    break
            elif kind == "word" or kind == "op" and (said.isdigit() or not parts and said in "$/+%&@!*^~?-"):
                lexer.next()
                follows = lexer.peek()
                if kind == "word":
                    if not parts and (m := _ANNOTATED.match(self.text, token[2])):
                        lexer.back(m.end())
                        lexer.next()
                        sign = "="
                        continue
                    if not parts and follows[0] == "op" and lexer.said(follows) in SETS and "\n" not in self.text[token[2] : follows[1]]:
                        sign = lexer.said(lexer.next())
                        targets.append(said)
                        continue
                known = self.bound.get(said) if kind == "word" else None
                if known is not None and follows[1] > token[2] - 1 and self.text[token[2] : token[2] + 1] not in ("(", "["):
                    value.others.append(known)
                elif parts or depth:
                    opaque = True
                else:
                    m = BARE.match(self.text, token[1])
                    opaque = bool(self.text[m.end() : m.end() + 1] in ("(", "[", "{")) or bool(_DOTTED.match(m[0])) or not re.search(r"[0-9+/=]", m[0])
                    bare = None if opaque else (token[1], m.end())
                    lexer.back(m.end())
                parts += 1
                if opaque and self.text[lexer.at : lexer.at + 1] in ("(", "["):
                    break  # a call or an item: what is in it is read as usual
                if not self._goes_on(depth, False):
                    break
                if bare:
                    bare = None
            else:
                break
        if bare:
            value.spans.append(bare)
        for target in targets:
            if value.spans or value.others:
                self.bound[target] = value
                self._tell(target, value)
            else:
                self.bound.pop(target, None)

    def _goes_on(self, depth: int, quoted: bool) -> bool:
        """Whether a sum goes on behind a part, in this line or behind a line break; its sign is read then."""
        lexer = self.lexer
        at = lexer.at
        token = lexer.next()
        crossed = False
        while token[0] == "line" or lexer.said(token) == "\\":
            crossed = crossed or token[0] == "line"
            token = lexer.next()
        said = lexer.said(token)
        if token[0] == "op" and said in ("+", "..") and self.text[token[2] : token[2] + 1] not in ("+", "="):
            behind, after = lexer.at, lexer.next()
            while after[0] == "line":
                after = lexer.next()
            follows = lexer.peek()
            gives = after[0] == "word" and follows[0] == "op" and lexer.said(follows) in SETS
            if after[0] == "string" and not gives or after[0] == "word" and not gives and (not crossed or lexer.said(after) in self.bound):
                lexer.back(behind)
                while lexer.peek()[0] == "line":
                    lexer.next()
                return True
        elif token[0] == "string" and quoted and (depth or not crossed):
            lexer.back(token[1])
            follows = self.text[token[2] : token[2] + 2].lstrip()[:1]
            if follows not in (":", "="):
                return True
        lexer.back(at)
        return False

    def _block(self, name: str, at: int) -> None:
        """A block of lines that are indented further than their key."""
        line = self.text.find("\n", at)
        if line < 0 or self.text[at:line].strip(" \t\r+-0123456789"):
            return
        start = end = line + 1
        while end < len(self.text):
            stop = self.text.find("\n", end)
            stop = len(self.text) if stop < 0 else stop
            own = self.text[end:stop]
            if own.strip() and len(own) - len(own.lstrip(" \t")) <= self.indent:
                break
            end = stop + 1
        end = min(end, len(self.text))
        if start < end:
            self._literal(name, start, end)
            self.lexer.back(max(end - 1, line))


def assigned_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose own name, or a name they are passed on to, is sensitive.

    One pass in the order of the text binds each name to its literals; a value that is a bound name, or
    a sum with one in it, hands them on to the names at its left; any other value unbinds them.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    return [(a, b, "literal") for a, b in _Parser(text).run()]


def ordered(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def all_spans(text: str) -> tuple[list, list]:
    """(base spans, all spans): an assigned literal counts unless a base span covers it."""
    base = ordered(base_spans(text))
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    more = []
    for span in assigned_spans(text):
        before = bisect_right(starts, span[0])
        if not before or reach[before - 1] < span[1]:
            more.append(span)
    return base, ordered([*base, *more])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str) -> str:
    """The text with each union of overlapping spans replaced by one mark."""
    out, at = [], 0
    for a, b, _ in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:3]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """Count and place the secrets of every text.

    One row per input row. Null and empty texts have no spans, texts of any length are read whole;
    repeated rows repeat; an empty table gives an empty one; other columns are not read.
    """

    @trimmed
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in _OUT.names[1:]}
            for text in strings(batch):
                base, every = all_spans(text)
                kinds = Counter(s[2] for s in every)
                for k in KINDS:
                    rows[f"n_{k}"].append(kinds[k])
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[f.name], f.type) for f in list(_OUT)[1:]]], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``; null texts stay null, ``n_chars`` follows where there is one."""
    names = docs.columns

    @trimmed
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4_000_000)):
            texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            columns = {k: batch.column(k) for k in names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(clean, docs.schema)

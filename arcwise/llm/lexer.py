"""Name-literal pairs of source and configuration text, and the literals that reach a sensitive name.

Read are, by small token patterns at the places where a pair can start:

* code: ``name = literal``, ``:=``, ``+=``, ``=>``, ``?=``, ``name: type = literal``, ``a, b = one, two``,
  chains ``a = b = literal``; strings with prefixes, triple quotes, backticks and escaped quotes, in
  parentheses or as the only argument of a call; joined strings (``+``, ``.``, side by side);
  a call with a name and a literal (``define('NAME', 'literal')``, ``getenv("NAME", "literal")``);
* env and ini lines, JSON and YAML pairs, YAML blocks (their first line), backslash line breaks,
  ``name: NAME`` with ``value: literal`` beside it;
* XML elements, attributes, and ``key="NAME" value="literal"``.

A name (also ``$NAME``, ``${NAME}``, in an f-string ``{NAME}``) stands for its last definition before, else
for the first one after it, through any number of names. A joined value is looked up two names deep: its
parts, and what they stand for. Every pattern reads a run once, so text of any length takes one pass.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

TYPE_DEPTH = 6  # brackets within brackets of a type


def _brackets(left: str, right: str) -> str:
    plain, within = rf"[^{left}{right}\n=:\"']*+", ""
    for _ in range(TYPE_DEPTH):
        within = rf"{left}{plain}{f'(?:{within}{plain})*+' if within else ''}{right}"
    return within


BRACKETS = _brackets(r"\[", r"\]") + "|" + _brackets("<", ">")
TYPE = rf"(?:&'\w++[ \t]++|[&*?])?+[A-Za-z_][\w.]*+(?:::\w++)*+(?:{BRACKETS}|[?*&])*+"
WORD = r"[A-Za-z_][\w.-]*+"
SIGN = r"(?:(?:\+|\|\||\?\?|\?|:)?=(?!=)>?|:)"
BLANK = r"(?:[ \t]|\\\r?\n)*+"
STRING = re.compile(
    r"""(?P<prefix>[bBrRfFuU]{1,2}(?=["']))?+"""
    r'''(?:"""(?P<long>(?:[^"\\]|\\[\s\S]|"(?!""))*+)"""'''
    r"""|'''(?P<tall>(?:[^'\\]|\\[\s\S]|'(?!''))*+)'''"""
    r"""|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'"""
    r"""|`(?P<tick>[^`]*+)`|\\"(?P<escaped>[^"\\\n]*+)\\"|\\'(?P<apart>[^'\\\n]*+)\\')"""
)
BARE = re.compile(r"\$\{[A-Za-z_]\w*+\}|[A-Za-z0-9+/_.=$@!%-]++(?:\$\{[A-Za-z_]\w*+\})*+")
START = re.compile(
    rf"""(?<![\w.-])[\d.-]*+(?P<name>{WORD})(?:\\?["'\]]){{0,2}}[ \t]*+"""
    rf"""(?::[ \t]*+(?P<type>{TYPE}(?:[ \t]*+\|[ \t]*+{TYPE})*+)[ \t]*+(?==(?![=>])))?+(?P<sign>{SIGN}){BLANK}"""
)
AGAIN = re.compile(rf"""(?:\\?["'\]]){{0,2}}[ \t]*+{SIGN}""")  # what makes a value a name itself
OPEN = re.compile(r"(?:(?:new|await)[ \t]++)?+(?P<callee>[A-Za-z_][\w.:]*+!?)?+\(\s*+")
# How calls begin whose argument says what to look up or to ask for.
LOOKUP = re.compile(r"(?:get|read|load|fetch|find|lookup|input|prompt|ask|env|param|var|config|require|import)", re.I)
CALL = re.compile(rf"""\(\s*+(?P<quote>["'])(?P<name>{WORD})(?P=quote)\s*+,\s*+""")
JOIN = re.compile(r"\s*+\+\s*+|[ \t]++\.\.?[ \t]++")
GAP = re.compile(r"[ \t]*+")
GAPS = re.compile(r"(?:\s|\\\n)*+")
BLOCK = re.compile(r"[|>][+-]?[ \t]*+\r?\n[ \t]++(?P<line>[^\s][^\n\r]*+)")
TUPLE = re.compile(
    rf"^[ \t]*+(?:(?:let|var|const|local|val|my)[ \t]++)?+[(\[]?(?P<names>{WORD}(?:[ \t]*+,[ \t]*+{WORD})++)[)\]]?"
    r"[ \t]*+:?=(?![=>])[ \t]*+[(\[]?",
    re.M,
)
COMMA = re.compile(r"[ \t]*+,\s*+")
LINE = re.compile(r"(?:^|(?<=\n))[ \t]*+(?:(?:export|set|ENV|ARG)[ \t]++)?+\Z")
REST = re.compile(r"[^\s\"'`&;$]++(?=[ \t]*+(?:[\r\n]|\Z))")
ELEMENT = re.compile(rf"<(?P<name>{WORD}(?::{WORD})?+)[^<>]*+>[ \t]*+(?P<value>[^<>\s][^<>\n]*+)</")
KEYED = re.compile(rf"""\b(?:key|name)[ \t]*+=[ \t]*+["'](?P<name>{WORD})["']\s++value[ \t]*+=[ \t]*+["'](?P<value>[^"'\n]++)["']""")
NAMED = re.compile(
    rf"""\b(?:name|key)["']?[ \t]*+:[ \t]*+["']?(?P<name>{WORD})["']?[ \t]*+,?\s*+["']?value["']?[ \t]*+:[ \t]*+""", re.I
)
REFERENCE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")
FIELD = re.compile(r"\{([A-Za-z_]\w*)\}")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Fixed word lists: parts of sensitive target names with their weight, and values that are no secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "secrets": 3, "token": 2,
    "apikey": 3, "credential": 3, "credentials": 3, "private": 1, "auth": 1, "key": 1, "api": 1, "access": 1,
    "client": 1, "signing": 1, "encryption": 1, "bearer": 2, "salt": 1, "jwt": 2, "dsn": 1,
}
PLACEHOLDERS = {
    "password", "passwd", "secret", "token", "changeme", "change_me", "example", "none", "null", "true", "false",
    "undefined", "string", "your_password", "your_token", "your_secret", "xxxxxx", "redacted",
}
LEAST_LITERAL = 6
LEAST_SCORE = 4.0
PHRASE_WORDS = 4  # words of a passphrase


def name_weight(name: str) -> int:
    parts = [part.lower() for part in PARTS.findall(name.rpartition(".")[2])]
    return sum(SENSITIVE.get(part, 0) for part in dict.fromkeys(parts))


def literal_score(value: str) -> float:
    """0 to 3: how much a literal looks like a key: its entropy per character, mixed classes, no spaces."""
    low = value.lower()
    if len(value) < LEAST_LITERAL or low in PLACEHOLDERS or " " in value or value.startswith(("$", "<", "%", "{")):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(kind, value)) for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3) + (1.0 if classes >= 2 else 0.0) + (1.0 if re.search("[0-9]", value) else 0.0)


@dataclass(slots=True)
class Part:
    """A piece of a value: a literal at a place, which may also be a name or hold names."""

    start: int
    end: int
    quoted: bool
    fields: bool = False  # an f-string


@dataclass(slots=True)
class Pair:
    name: str
    parts: list[Part]


def _literal(found: re.Match) -> Part:
    group = found.lastgroup
    if group == "prefix":  # an empty string
        return Part(found.end(), found.end(), True)
    prefix = found.group("prefix")
    return Part(*found.span(group), True, bool(prefix) and "f" in prefix.lower())


def _operand(text: str, at: int) -> tuple[list[Part], int]:
    """The strings side by side, the string in brackets or the bare word at a place, and where it ends."""
    found, gap, closed = STRING.match(text, at), GAP, None
    if not found:
        opened = OPEN.match(text, at)
        if opened:
            found, gap, closed = STRING.match(text, opened.end()), GAPS, opened
            if not found:
                return [], at
    if not found:
        found = BARE.match(text, at)
        return ([Part(*found.span(), False)], found.end()) if found else ([], at)
    parts = []
    while found:
        parts.append(_literal(found))
        end = found.end()
        found = STRING.match(text, gap.match(text, end).end())
    after = GAPS.match(text, end).end()
    callee = closed and closed.group("callee")
    if callee and (text[after : after + 1] != ")" or LOOKUP.match(re.split(r"[.:]", callee)[-1])):
        return [], at  # one of several arguments, or not the value itself
    return parts, after + 1 if closed and text[after : after + 1] == ")" else end


def _value(text: str, at: int) -> tuple[list[Part], int]:
    """Operands joined by signs."""
    parts, end = _operand(text, at)
    while parts:
        sign = JOIN.match(text, end)
        more, after = _operand(text, sign.end()) if sign else ([], end)
        if not more:
            break
        parts, end = parts + more, after
    return parts, end


def _pairs(text: str) -> list[Pair]:
    """All pairs of a text by place."""
    placed: list[tuple[int, Pair]] = []
    heads: list[tuple[int, int]] = []
    for found in TUPLE.finditer(text):
        at = found.end()
        for name in re.split(r"[ \t]*,[ \t]*", found.group("names")):
            parts, at = _value(text, at)
            if not parts:
                break
            placed.append((found.start(), Pair(name, parts)))
            comma = COMMA.match(text, at)
            at = comma.end() if comma else at
        heads.append(found.span("names"))
    for pattern in (CALL, NAMED):
        for found in pattern.finditer(text):
            parts, _ = _value(text, found.end())
            if parts:
                placed.append((found.start(), Pair(found.group("name"), parts)))
    for pattern in (ELEMENT, KEYED):
        for found in pattern.finditer(text):
            start, end = found.span("value")
            placed.append((found.start(), Pair(found.group("name"), [Part(start, start + len(found.group("value").rstrip()), True)])))
    at, head = 0, 0
    while found := START.search(text, at):
        at = found.end()
        while head < len(heads) and heads[head][1] <= found.start("name"):
            head += 1
        if head < len(heads) and heads[head][0] <= found.start("name"):
            continue
        block = BLOCK.match(text, at) if found.group("sign") == ":" else None
        if block:
            parts, end = [Part(*block.span("line"), True)], block.end()
        else:
            parts, end = _value(text, at)
        if not parts:
            continue
        last = parts[-1]
        rest = None
        if len(parts) == 1 and not last.quoted and found.group("sign") == "=" and found.end("sign") == at:
            before = text.rfind("\n", 0, found.start("name")) + 1
            if found.start("name") - before < 64 and LINE.fullmatch(text[before : found.start("name")]):
                rest = REST.match(text, at)
        if rest and rest.end() > end:
            cut = len(rest.group().rstrip(",;:)]}>"))
            last.end = max(last.end, at + cut)
            end = rest.end()
        placed.append((found.start("name"), Pair(found.group("name"), parts)))
        kind = found.group("type")
        if kind and NAME.match(kind) and name_weight(kind) >= 2:
            placed.append((found.start("type"), Pair(kind, parts)))  # "section: name = literal"
        # A bare value that is given a value itself is the next name.
        again = not last.quoted and AGAIN.match(text, last.end)
        at = last.start if again and last.start > found.start("name") else end
    placed.sort(key=lambda one: one[0])
    return [pair for _, pair in placed]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through other names."""
    pairs = _pairs(text)
    places: dict[str, list[int]] = {}
    for number, pair in enumerate(pairs):
        places.setdefault(pair.name, []).append(number)

    def definition(name: str, number: int) -> int | None:
        """The name's last definition before this place, else the first one after it."""
        own = places.get(name, [])
        at = bisect_left(own, number)
        later = at + (at < len(own) and own[at] == number)
        return own[at - 1] if at else own[later] if later < len(own) else None

    def names_in(part: Part) -> list[tuple[int, int, str]]:
        """Names that a part stands for or holds, with their places; only defined ones count within a literal."""
        value = text[part.start : part.end]
        if not part.quoted and NAME.match(value):
            return [(part.start, part.end, value)]
        marks = list(REFERENCE.finditer(value)) if "$" in value else []
        marks += list(FIELD.finditer(value)) if part.fields else []
        found = [(part.start + m.start(), part.start + m.end(), next(filter(None, m.groups()))) for m in marks]
        return [one for one in found if one[2] in places or one[:2] == (part.start, part.end)]

    origins: dict[int, int | None] = {}

    def origin(number: int) -> int | None:
        """The pair whose value a pair stands for; none for names that only stand for each other."""
        path = []
        while number not in origins:
            origins[number] = None  # met again before it is known: a circle
            path.append(number)
            parts = pairs[number].parts
            named = names_in(parts[0]) if len(parts) == 1 else []
            whole = len(named) == 1 and named[0][:2] == (parts[0].start, parts[0].end)
            other = definition(named[0][2], number) if whole else None
            if other is None:
                origins[number] = number
            else:
                number = other
        for one in path:
            origins[one] = origins[number]
        return origins[number]

    def literals(number: int, deep: bool) -> list[Part]:
        """The literals of a pair's value; those of the names in it too if deep."""
        found = []
        for part in pairs[number].parts:
            named = names_in(part)
            if not named or (len(pairs[number].parts) == 1 and named[0][:2] == (part.start, part.end)):
                found.append(part)
                continue
            at = part.start
            for start, end, name in sorted(named):
                if start > at:
                    found.append(Part(at, start, part.quoted))
                other = definition(name, number) if deep else None
                first = origin(other) if other is not None else None
                if first is not None and first != number:
                    found += literals(first, False)
                at = end
            if at < part.end:
                found.append(Part(at, part.end, part.quoted))
        return found

    spans = set()
    for number, pair in enumerate(pairs):
        weight = name_weight(pair.name)
        first = origin(number) if weight >= 2 else None
        if first is None:
            continue
        parts = literals(first, True)
        value = "".join(text[part.start : part.end] for part in parts)
        certain = first != number or any(part.quoted for part in parts)
        if not certain and not re.search("[0-9]", value):
            continue
        score = literal_score(value)
        phrase = weight >= 3 and certain and len(set(value.lower().split(" "))) >= PHRASE_WORDS
        phrase = phrase and re.fullmatch(r"[A-Za-z0-9-]+(?: [A-Za-z0-9-]+)+", value)
        if phrase and ("phrase" in pair.name.lower() or re.search("[0-9]", value)):
            score = 1.0
        if score > 0 and min(3, weight) + score >= LEAST_SCORE:
            spans |= {(part.start, part.end) for part in parts if part.end > part.start}
    return sorted(spans)

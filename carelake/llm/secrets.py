"""Secret scan by assignment-aware lexing.

Base kinds (plain patterns, leftmost and non-overlapping each, too short ones dropped):

* ``assign``  a sensitive name, ``:`` or ``=``, and a value of 6 or more characters
* ``access``  ``AKIA...`` of 20 or more characters
* ``hex``     24 or more lowercase hex digits

The lexer adds spans of literals that are bound to a sensitive name. It reads source and configuration
syntax in one pass over the names (dotted or hyphenated runs count as one name and are read once, so the
time stays in proportion to the text) and takes statements (``name = literal``, ``name: literal``, ``name := literal``,
``"name" => literal``, ``name=literal`` as keyword argument or in a query string, ``export NAME=...``,
``<name>literal</name>``, ``name: type = literal``, ``var name type = literal``, ``name[] = literal``,
``#define name literal``, ``a = name = literal``, literals in parentheses or back quotes, block scalars ``name: >-``) for name-literal pairs. Right sides
are joined (``"ab" + "cd"``, adjacent strings) and propagated: ``x = "..."`` then ``password = x`` marks the
literal of x, through any number of steps. What a name is bound to elsewhere in the text, below its use
or before another value, is propagated as well, each such binding by itself. A literal's score adds up how sensitive the words of its names are and how much it looks like
a secret (length, kinds of characters, entropy); placeholders and references score nothing.

* ``literal``   a literal bound to a sensitive name itself
* ``constant``  a literal that reaches a sensitive name through other names

Spans are code points of the text, end exclusive. The added spans leave the base ones untouched.
Null and empty texts have no spans. Equal rows have equal results. An empty table gives an empty result.
Long texts are read whole; batches hold few rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched to be dropped
MIN_VALUE, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "literal", "constant")

# Words of a name and how much they say: 1.0 is enough by itself with a plausible value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0,
             "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "pin": 0.4, "key": 0.4, "auth": 0.5,
             "private": 0.4, "access": 0.3, "api": 0.4, "signing": 0.4, "encryption": 0.4, "session": 0.2,
             "bearer": 0.6, "cookie": 0.3, "salt": 0.5, "dsn": 0.5, "jwt": 0.7, "pass": 0.8}
HARMLESS = {"name", "type", "url", "path", "file", "length", "len", "size", "count", "id", "field", "label",
            "hint", "policy", "prompt", "expiry", "ttl", "public", "header", "param", "regex", "min", "max"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|none|null|nil|true|false|undefined|todo|tbd|changeme|change_me|"
                         r"example|sample|dummy|test|placeholder|redacted|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")
THRESHOLD = 1.3

STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\\n]|\\.)*`'
QUOTES = "\"'`"
NAME = r"(?<![\w$])[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"  # possessive: no backtracking in long words
# name, binder, right side: strings and names joined by +, or one bare value up to a separator
BINDING = re.compile(
    rf"""(?P<quote>["'])?(?P<name>{NAME})(?(quote)(?P=quote))\]?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*"""
    rf"""(?P<value>(?:(?:{STRING})|{NAME}(?![\w.+/=-]))(?:[ \t]*\+?[ \t]*(?:{STRING})|[ \t]*\+[ \t]*{NAME})*|[^\s"'`,;&<>(){{}}\[\]]+)""")
# Declarations whose literal BINDING does not reach; each with a text without which it can't match.
LITERALS = rf"""(?:\([ \t\r\n]*+)?(?P<value>(?:(?:{STRING})|{NAME}(?![\w.+/=(-]))(?:[ \t\r\n]*+\+?[ \t\r\n]*+(?:{STRING})|[ \t]*\+[ \t]*{NAME})*)"""
TYPE = (r"[&*]?(?:'\w++[ \t]+)?(?:mut[ \t]+)?[A-Za-z_][\w.:]*+(?:[ \t]*[<\[][^\n=\"';]{0,60}[>\]])?(?:[ \t]*\|[ \t]*[\w.]++){0,4}[?*]?"
        r"(?:\[\w*\])?")
DECLARED = [(need, re.compile(x)) for need, x in (
    ("]", rf"(?P<name>{NAME})[ \t]*\[\w*\][ \t]*=(?![=>])[ \t]*{LITERALS}"),                      # char password[] = ".."
    ("(", rf"""(?P<quote>["'])?(?P<name>{NAME})(?(quote)(?P=quote))\]?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*(?=\(){LITERALS}"""))]
TYPED = re.compile(rf"(?P<name>{NAME})[?!]?[ \t]*:[ \t]*{TYPE}[ \t]*=(?![=>])[ \t]*{LITERALS}")     # password: str = ".."
TYPED_COLON, TYPE_WORD = re.compile(r"[?!]?[ \t]*+:[ \t]*+"), re.compile(r"[\w.:]*+")
# those that begin with a word of their own
OPENED = [(need, re.compile(x)) for need, x in (
    ("define", rf"#[ \t]*+define[ \t]++(?P<name>{NAME})[ \t]+{LITERALS}"),
    (" ", rf"\b(?:var|const|let|static)[ \t]+(?P<name>{NAME}[ \t]+{NAME})[ \t]*=(?![=>])[ \t]*{LITERALS}"))]  # var password string = ".."
# a = password = "..": names that another binder follows, however many, and what stands behind the last
CHAIN = re.compile(rf"(?P<name>{NAME}(?:[ \t]*+=(?![=>])[ \t]*+{NAME}(?=[ \t]*+=(?![=>])))++)[ \t]*+=(?![=>])[ \t]*+")
VALUE = re.compile(LITERALS)
RUN = re.compile(NAME)
BLOCK = re.compile(rf"(?P<name>{NAME})[ \t]*+:[ \t]*+[|>][+-]?\d?[ \t]*+\r?\n[ \t]++(?P<value>[^\s\"'`,;&<>(){{}}\[\]]++)[ \t\r]*+(?:\n|\Z)")
ELEMENT = re.compile(rf"<(?P<name>{NAME})>(?P<value>[^<>\s]+)</(?P=name)>")
PART = re.compile(rf"(?P<string>{STRING})|(?P<name>{NAME})")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    joined = "".join(words)
    return max(sum(SENSITIVE.get(w, 0.0) for w in words), 1.0 if joined.endswith(("apikey", "accesskey", "privatekey")) else 0.0)


def value_score(value: str) -> float:
    """0 for what can't be a secret, else up to 1."""
    if len(value) < MIN_VALUE or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    n = Counter(value)
    bits = -sum(x / len(value) * math.log2(x / len(value)) for x in n.values())
    return min(1.0, 0.1 * kinds + 0.15 * bits + min(len(value), 32) / 64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    low, out = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "api")):  # lower() keeps ASCII letters, so none is missed
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def at_runs(pattern: re.Pattern, text: str, runs: list[re.Match]):
    """What ``pattern.finditer`` finds. It begins with a name, which may stand behind a quote; whether it matches depends on the
    end of the name's run, so it is tried at the start of each run only and not again behind every dot and hyphen."""
    done = 0
    for r in runs:
        start = r.start()
        if start >= done:
            m = pattern.match(text, start - 1) if start > done and text[start - 1] in QUOTES else None
            m = m or pattern.match(text, start)
            if m:
                done = m.end()
                yield m


def typed(text: str, runs: list[re.Match]):
    """TYPED at each run. Of a long type, all names inside fail like the first: the rest hangs on where the type ends."""
    done = dead = 0
    for r in runs:
        colon = TYPED_COLON.match(text, r.end()) if r.start() >= done else None
        if not colon or colon.end() < dead:
            continue
        m = TYPED.match(text, r.start())
        if m:
            done = m.end()
            yield m
        else:
            end = TYPE_WORD.match(text, colon.end()).end()
            dead = end if text[end - 3:end] != "mut" else dead  # ``mut`` may end a word and begin a type


def bindings(text: str):
    """(name, parts, bare) in the order of the text; a part is a name (str) or a literal (start, end), ``bare`` the place of a
    right side that is one unquoted word."""
    literal = any(q in text for q in QUOTES)
    runs = list(RUN.finditer(text))
    declared = [(m, m) for need, x in DECLARED if literal and need in text for m in at_runs(x, text, runs)]
    declared += [(m, m) for m in (typed(text, runs) if literal and ":" in text else ())]
    declared += [(m, m) for need, x in OPENED if literal and need in text for m in x.finditer(text)]
    # a chain is passed over as a whole, with or without a literal behind it, so long ones are read once
    chains = at_runs(CHAIN, text, runs) if literal and "=" in text else ()
    declared += [(m, v) for m in chains if (v := VALUE.match(text, m.end()))]
    taken = {m.start("name") for m, _ in declared}
    plain = [(m, m) for m in at_runs(BINDING, text, runs) if m.start("name") not in taken]
    elements = [(m, m) for m in ELEMENT.finditer(text)] if "</" in text else []
    blocks = [(m, m) for m in at_runs(BLOCK, text, runs)] if ":" in text and ("|" in text or ">" in text) else []
    for m, v in sorted([*plain, *declared, *elements, *blocks], key=lambda x: x[0].start("name")):
        at, value = v.start("value"), v["value"]
        if m.start("name") in taken and m.re is not BLOCK:  # several targets, or a name and its type
            parts = [(at + p.start() + 1, at + p.end() - 1) if p["string"] else p["name"] for p in PART.finditer(value)]
            for name in RUN.findall(m["name"]):
                yield name, parts, None
            continue
        if value[0] in QUOTES or PART.fullmatch(value) or "+" in value and PART.match(value):
            parts = [(at + p.start() + 1, at + p.end() - 1) if p["string"] else p["name"] for p in PART.finditer(value)]
        else:
            parts = [(at, v.end("value"))]
        bare = len(parts) == 1 and isinstance(parts[0], str)
        yield m["name"], parts, (at, v.end("value")) if bare else None


def reached(node: list) -> list[tuple[int, int, bool]]:
    """Literals of a bound right side in order, each once, and whether it came through another name. Right sides hold those of
    their names by reference; they are only followed for sensitive names."""
    out, seen, stack = {}, {id(node)}, [(node, 0, False)]
    while stack:
        node, at, far = stack.pop()
        while at < len(node):
            part, at = node[at], at + 1
            if isinstance(part, tuple):
                out[(*part, far)] = None
            elif id(part) not in seen:
                seen.add(id(part))
                stack.append((node, at, far))
                node, at, far = part, 0, True
    return list(out)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name."""
    if not ("=" in text or ":" in text or "</" in text or "define" in text):
        return []
    found = list(bindings(text))
    scores = {name: name_score(name) for name in {n for n, _, _ in found}}
    if not any(scores.values()):
        return []
    out = set()
    bound: dict[str, list] = {}
    for name, parts, bare in found:
        node = [p if not isinstance(p, str) else bound[p] if p in bound else bare for p in parts]
        node = [p[0] if isinstance(p, list) and len(p) == 1 and isinstance(p[0], list) else p for p in node if p]
        bound[name] = node
        if scores[name] > 0 and node:
            reach = reached(node)
            if reach and scores[name] + value_score("".join(text[a:b] for a, b, _ in reach)) >= THRESHOLD:
                out.update((a, 4 if far else 3, b) for a, b, far in reach if b > a and (not bare or far or _mixed(text[a:b])))
    # the other bindings of the names that sensitive names refer to, most sensitive first, each once
    elsewhere: dict[str, list] = {}
    for name, parts, bare in found:
        elsewhere.setdefault(name, []).append((parts, bare))
    seen = set()
    for score, names in sorted(((scores[n], [p for p in parts if isinstance(p, str) and p != n]) for n, parts, _ in found
                                if scores[n] > 0), key=lambda x: -x[0]):
        while names:
            name = names.pop()
            if name in seen or name not in elsewhere:
                continue
            seen.add(name)
            for parts, bare in elsewhere[name]:
                own = [p for p in parts if not isinstance(p, str)]
                if own and score + value_score("".join(text[a:b] for a, b in own)) >= THRESHOLD:
                    out.update((a, 4, b) for a, b in own if b > a)
                names += [p for p in parts if isinstance(p, str)]
    return sorted(out)


def _mixed(value: str) -> bool:
    """An unquoted word counts only with letters and digits: prose after a colon is no secret."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = [0, 0, 0]
    for _, k, _ in base:
        n[k] += 1
    spans = sorted(base + lexed_spans(text))
    return *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)


FOUND = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")],
                      T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(FOUND)
def secrets(texts: pa.Array) -> pa.Array:
    cols = list(zip(*map(scan, texts.to_pylist()))) or [()] * 5
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], FOUND.names)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", secrets("text").alias("x")).select("doc_id", "x.*")

"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with the literal tokens that each
match must contain. A pass over all URLs counts those tokens; each rule is filed under its
rarest one. A URL's own tokens then fetch the few candidate rules, and only those run their
regular expressions. Work per URL is its token count plus its candidates, whatever the number
of rules. Both passes are narrow maps; only one count per rule token and partition is shuffled.

Defined results: a null URL or one without ``://`` has empty host and path, and the method's
verdict for it is ``allow``. Repeated rows are judged alike, row by row. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"[A-Za-z0-9]+")


def tokens_of(key: str) -> set[str]:
    """A URL's tokens as they are and in lower case: a rule's own may be of either kind."""
    found = set(TOKEN.findall(key))
    return found.union(t.lower() for t in found)


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    #: Site rules decide first and report their name; general ones give the method's verdict.
    site: bool


def site_rule(action: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, rest = text.partition("/")
    host = host.lower()
    path = slash + rest
    tokens = TOKEN.findall(host)
    found = TOKEN.findall(path)
    # the last token of a prefix may go on in the URL, so it is no literal of its own
    tokens += found[:-1] if found and path[-1:].isalnum() else found
    return Rule(text, action, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def word_rule(action: str, word: str) -> Rule:
    """Fits where the word stands alone, between other characters than letters and digits."""
    return Rule(word, action, rf".*?(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word,), False)


def pattern_rule(action: str, name: str, regex: str, tokens: tuple[str, ...] = ()) -> Rule:
    return Rule(name, action, regex, tokens, False)


#: Conditions of list rules that hold for a page's own address.
OWN = frozenset(("all", "document", "doc", "important", "match-case"))


def list_rule(line: str, conditional: bool = True) -> Rule | None:
    """A rule in the syntax that public filter lists share; None for comments, blanks and rules on page elements.

    ``||name^`` fits a host and its subdomains, ``|`` an end, ``*`` anything, ``^`` a separator or the end, ``/.../`` is a regular
    expression, a leading ``@@`` allows. What follows ``$`` are conditions of browsers (who asks, and what for), which a URL alone can't tell: they
    don't count, or, if not ``conditional``, the rule doesn't. Lists are written against whole URLs; here they fit host and path. A regular expression
    that can't be read raises re.error.
    """
    text = line.strip()
    if not text or text[0] in "!#[" or "##" in text or "#@#" in text:
        return None
    action = "allow" if text.startswith("@@") else "block"
    body = text.removeprefix("@@")
    if len(body) > 1 and body[0] == body[-1] == "/":
        re.compile(body[1:-1])
        return pattern_rule(action, text, f".*?(?:{body[1:-1]})")
    asked = re.search(r"\$([\w~,=|.-]+)$", body)
    if asked:
        if not conditional and not OWN.issuperset(asked[1].split(",")):
            return None
        body = body[: asked.start()]
    body = re.sub(r"^\|(?:https?:|\*:)?//", "|", body)
    host, begin, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    core = body.strip("|")
    if not core.strip("*^"):
        return None
    regex = "".join({"*": ".*?", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or re.escape(c.lower()) for c in core)
    regex = (r"(?:[^/]*\.)?" if host else "" if begin else ".*?") + f"(?ai:{regex})" + ("$" if end else "")
    # a token that the rule's own text holds whole: nothing may go on at its ends
    whole = [m[0].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", core) if (m.start() > 0 or host or begin) and (m.end() < len(core) or end)]
    return Rule(text, action, regex, tuple(whole), False)


def list_rules(lines: Iterable[str], conditional: bool = True) -> tuple[Rule, ...]:
    """The rules of a filter list; lines that can't be read are left out with a warning. A list is what one machine holds; each executor
    gets it whole."""
    rules = []
    for line in lines:
        try:
            rules.append(list_rule(line, conditional))
        except re.error as why:
            warnings.warn(f"filter rule left out: {line.strip()[:200]}: {why}", stacklevel=2)
    return tuple(r for r in rules if r)


SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)
GENERAL_RULES = (
    *(word_rule("block", w) for w in ("casino", "bets", "poker", "porn", "xxx", "adult", "pills", "warez")),
    # one rule for each word: a rule's tokens must be in all it matches
    *(pattern_rule("block", f"ad servers: {w}", rf"(?:[^/]*\.)?ads?-{w}\.", (w,)) for w in ("track", "tracker", "tracking")),
    pattern_rule("block", "click servers", r"(?:[^/]*\.)?click-ads?\.", ("click",)),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each token of a rule occurs; at most one entry for each rule token."""
    wanted = frozenset(t for r in rules for t in r.tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for (key,) in common.rows_of(batch, "key"):
                seen.update(wanted.intersection(tokens_of(key)))
        yield pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())}, pa.schema([("token", pa.string()), ("n", pa.int64())]))

    host, path = host_path(F.col("url"))
    counted = pages.select(F.concat(host, path).alias("key")).mapInArrow(count, "token string, n long")
    return {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """token -> the rules filed under it; rules without a literal token are tried on every URL."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + GENERAL_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url)."""
    index, always = build_index(rules, token_counts(pages, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.regex, re.DOTALL) for r in rules]
        # longest wins; then block before allow, then the name
        order = sorted(range(len(rules)), key=lambda i: (not rules[i].site, -len(rules[i].name), rules[i].action != "block", rules[i].name))
        rank = {i: k for k, i in enumerate(order)}
        for batch in batches:
            names, verdicts = [], []
            for host, path in common.rows_of(batch, "host", "path"):
                key = host + path
                fetched = set(always)
                for token in tokens_of(key):
                    fetched.update(index.get(token, ()))
                best = next((i for i in sorted(fetched, key=rank.__getitem__) if compiled[i].match(key)), None)
                names.append(rules[best].name if best is not None and rules[best].site else None)
                verdicts.append(rules[best].action if best is not None else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_path(F.col("url"))
    told = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = told.schema["page_id"].dataType.simpleString()
    return told.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")

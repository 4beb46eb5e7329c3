"""URL filters: path rules for hosts, then a weighted vocabulary.

The vocabulary is a table of terms, each strict or soft, with a weight. One Aho-Corasick automaton finds all terms in the
lower-cased URL. A hit counts only between boundaries: the characters beside it are not ASCII letters or digits. One
strict term rejects, and so do two or more different soft terms whose weights add up to `soft_needed`.

Rules are looked up, not tried one by one: by each domain above the host, and there by the lengths that its rules' paths
have. So a URL takes a few look-ups however many rules there are.

Cases: a URL that is null or has no `://` has an empty host and path, fits no rule, and is judged by the vocabulary
on what text it has (null: allow); a rule without a host fits nothing; ties between rules of one length go to the
longer host; repeated rows are judged each; an input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarnweave.llm.common import lower_ascii, spare

#: Terms, their kinds and weights: words of gambling, pornography, shady medicine, malware and link spam, in several
#: languages. Any table of this form can take its place.
VOCABULARY = (
    *((t, "strict", 1.0) for t in "casino casinos kasino pills porn porno pornos hentai viagra cialis xxx spam warez malware phishing keygen sexcam".split()),
    *((t, "soft", 1.0) for t in "free cheap bet bets win ads track tracker click deal deals farm loan loans poker bonus adult sexy jackpot slots payday escort torrent".split()),
    *((t, "soft", 1.0) for t in "kostenlos wetten kredit billig gratis gratuit gratuite pari paris-sportifs apuestas prestamo barato scommesse".split()),
    *((t, "soft", 0.5) for t in "best top online now buy shop sale win24 offer offers angebot promo oferta soldes".split()),
)
SOFT_NEEDED = 2.0

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(4)
def automaton(terms: tuple[tuple[str, str, float], ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, kind, weight in terms:
        out.add_word(term, (term, kind, weight))
    if len(out):
        out.make_automaton()
    return out


def hits(url: str, terms: tuple[tuple[str, str, float], ...]) -> tuple[int, int, float]:
    """How many different strict and soft terms a lower-cased URL has, and the weights of the soft ones."""
    found = {}
    if terms:
        for last, (term, kind, weight) in automaton(terms).iter(url):
            first = last - len(term)
            if (first < 0 or url[first] not in _LETTERS) and (last + 1 == len(url) or url[last + 1] not in _LETTERS):
                found[term] = kind, weight
    soft = [weight for kind, weight in found.values() if kind == "soft"]
    return len(found) - len(soft), len(soft), math.fsum(soft)


class Rules:
    """Rules by host: the lengths of its paths, longest first, and what each path says. Of a host and path that come twice,
    an allowing rule counts."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.hosts: dict[str, tuple[list[int], dict[str, str]]] = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks: {action}")
            if host:
                paths = self.hosts.setdefault(host, ([], {}))[1]
                paths[path] = min(action, paths.get(path, action))
        for lengths, paths in self.hosts.values():
            lengths.extend(sorted({len(x) for x in paths}, reverse=True))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits (of rules of one length, that of the longer host), and its action; None where none fits."""
        best, rule, action, at = 0, None, None, 0
        while True:
            own = host[at:]
            lengths, paths = self.hosts.get(own, ((), {}))
            for n in lengths:
                if len(own) + n <= best:
                    break
                said = paths.get(path[:n]) if n <= len(path) else None
                if said is not None:
                    best, rule, action = len(own) + n, own + path[:n], said
                    break
            at = host.find(".", at) + 1
            if not at:
                return rule, action


def _with(df: DataFrame, made: T.StructType, inputs: Sequence[Column], values: Callable[..., tuple]) -> DataFrame:
    """df with the columns that values() gives for the inputs of each row; of df's columns, those of other names. Narrow."""
    kept = [f for f in df.schema if f.name.lower() not in made.names]
    names = [f.name for f in kept]
    taken = spare(df, *[f"_input{k}" for k in range(len(inputs))])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(len(names) + k).to_pylist() for k in range(len(taken))))
            got = [values(*x) for x in rows]
            columns = [pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *columns], [*names, *made.names])

    return df.select(*[f"`{n}`" for n in names], *[x.alias(n) for x, n in zip(inputs, taken)]).mapInArrow(run, T.StructType([*kept, *made.fields]))


def _terms(terms: Sequence[tuple[str, str, float]]) -> tuple[tuple[str, str, float], ...]:
    """Different terms, lower-cased. Of a term that comes twice, a strict row counts, or the heavier one."""
    own: dict[str, tuple[str, float]] = {}
    for term, kind, weight in terms:
        if kind not in ("strict", "soft"):
            raise ValueError(f"a term is strict or soft: {kind}")
        if term:
            own[term.lower()] = max(own.get(term.lower(), ("", -math.inf)), (kind, float(weight)))
    return tuple((t, *x) for t, x in sorted(own.items()))


_COUNTED = T.StructType().add("n_strict", "integer").add("n_soft", "integer").add("soft_weight", "double")
_RULED = T.StructType([*_COUNTED.fields]).add("rule", "string").add("verdict", "string")


def _lower(url: str) -> Column:
    return F.coalesce(lower_ascii(F.col(url)), F.lit(""))


def vocabulary(df: DataFrame, url: str = "url", terms: Sequence[tuple[str, str, float]] = VOCABULARY) -> DataFrame:
    """df with n_strict and n_soft (int), how many different terms of each kind the URL holds, and soft_weight. Of a term
    that comes twice, a strict row counts, or the heavier one. Narrow: no shuffle."""
    own = _terms(terms)
    return _with(df, _COUNTED, [_lower(url)], lambda x: hits(x, own))


def judge(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url: str = "url",
    terms: Sequence[tuple[str, str, float]] = VOCABULARY,
    soft_needed: float = SOFT_NEEDED,
) -> DataFrame:
    """df with host, path, n_strict, n_soft, soft_weight, rule and verdict. `rules`: (action, host, path), the caller's list,
    which goes along with each task; a rule fits its host and all subdomains where the path starts with its own. Narrow."""
    out = ("host", "path", *_RULED.names)
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in out])
    own, ruled = _terms(terms), Rules(rules)
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    df = df.withColumns({
        "host": lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    })

    def judged(lower: str, host: str, path: str) -> tuple:
        n_strict, n_soft, weight = hits(lower, own)
        rule, action = ruled.longest(host, path)
        rejected = n_strict > 0 or (n_soft >= 2 and weight >= soft_needed)
        return n_strict, n_soft, weight, rule, action or ("block" if rejected else "allow")

    return _with(df, _RULED, [_lower(url), F.col("host"), F.col("path")], judged)

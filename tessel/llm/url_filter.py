"""URL filter: a trie over reversed host labels, then path segments; the longest entry that fits decides between allow and block.

The trie is built once and broadcast; the size of its rules is checked first. A url walks host labels from the right, and at every node it
passes, the path segments below it; a segment is looked up once for each length that partial segments have there. Its cost follows its own length and not the
number of rules.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query: verdict and host/path.
RULES = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]
MAX_BYTES = 64 << 20

_LOWER = {i: i + 32 for i in range(65, 91)}
_URL = re.compile(r"^(?:(?!://).)*?://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lowered) and path; both empty for null or without ://."""
    m = _URL.match(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Trie:
    """node: [children by label, path node or None]; path node: [children by whole segment, {partial last segment: rule}, lengths of these, longest first].

    A rule's path, such as /en/1, splits into whole segments (en) and a last one (1, or empty after a closing slash) that a url's segment
    must start with. A url is longer than the rule or as long; the depth of a rule is its host labels, then the length of its path."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for verdict, rule in rules:
            if verdict not in (ALLOW, BLOCK) or "/" not in rule:
                raise ValueError(f"a rule is allow or block, and host/path: {verdict} {rule}")
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}, []]
            at = node[1]
            *whole, last = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, []])
            if len(last) not in at[2]:
                at[2].append(len(last))
                at[2].sort(reverse=True)
            old = at[1].get(last)
            if old is None or old[1] == BLOCK:  # allow wins where both name the same place
                at[1][last] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest entry that fits, or None."""
        segments = path[1:].split("/") if path[:1] == "/" else None
        best, node = None, self.root
        for label in [None, *reversed(host.split("."))] if host else [None]:
            if label is not None:
                node = node[0].get(label)
                if node is None:
                    break
            found = node[1] and segments is not None and self._below(node[1], segments)
            best = found or best
        return best

    @staticmethod
    def _below(at: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            best = next((at[1][segment[:n]] for n in at[2] if segment[:n] in at[1]), best)
            at = at[0].get(segment)
            if at is None:
                break
        return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = ALLOW, url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (the rule's, else default); columns of these names are replaced.

    A rule's host fits itself and all its subdomains, if the url's path starts with the rule's path; of the rules that fit, that of most host
    labels wins, then that of the longest path; allow wins over block for the same place. A path without a leading slash (an empty one)
    fits no rule. Defined cases: a null url, or one without ://, has an empty host and path and gets the default; repeated rows are judged
    alike; rules over MAX_BYTES raise ValueError, as the trie is broadcast."""
    rules = list(rules)
    if sum(len(r) for _, r in rules) * 20 > MAX_BYTES:
        raise ValueError(f"the rules are over {MAX_BYTES} bytes as a trie")
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(Trie(rules)))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def run(it: pd.Series) -> pd.DataFrame:
        trie = pickle.loads(shared.value)
        out = []
        for u in it:
            host, path = split_url(u)
            rule, verdict = trie.match(host, path) or (None, default)
            out.append((host, path, rule, verdict))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    kept = pages.drop("host", "path", "rule", "verdict")
    return kept.withColumn("__j", run(F.col(url))).select(*[F.col(f"`{c}`") for c in kept.columns], "__j.host", "__j.path", "__j.rule", "__j.verdict")

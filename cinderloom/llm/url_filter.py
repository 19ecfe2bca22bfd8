"""URL filter with a trie over reversed host labels and path segments (operator 8)."""

from __future__ import annotations

import json
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns, written

ALLOW, BLOCK = "allow", "block"
#: Rules that one broadcast trie may hold; more are judged trie after trie.
MAX_RULES = 2_000_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there
    up to ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


class Trie:
    """Host labels from the last, and below each the path segments of its rules.

    A path rule is a prefix: its whole segments are steps, what follows the last ``/`` is a prefix of the next segment. Such
    tails are kept by length, so a segment is looked up once for each length that occurs, however many rules a place has.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.root: tuple[dict, dict] = ({}, {})  # (labels below, path node); a path node: segments below, tails by length
        # Of an allow and a block entry for one place, block stands.
        for rule in sorted(set(rules), key=lambda r: (r.host, r.path, r.verdict)):
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, ({}, {}))
            *whole, tail = rule.path.split("/")
            path = node[1]
            for segment in whole:
                path = path.setdefault(("step", segment), {})
            path.setdefault("tails", {}).setdefault(len(tail), {})[tail] = rule
        self._longest_first(self.root)

    def _longest_first(self, root: tuple[dict, dict]) -> None:
        hosts = [root]
        while hosts:
            labels, path = hosts.pop()
            hosts += labels.values()
            paths = [path]
            while paths:
                p = paths.pop()
                paths += [v for k, v in p.items() if k != "tails"]
                if "tails" in p:
                    p["tails"] = dict(sorted(p["tails"].items(), reverse=True))

    def match(self, host: str, path: str) -> Rule | None:
        """The rule of most host labels, and of these the one of the longest path. Time grows with the url, not with the rules."""
        found, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            found = self._path(node[1], segments) or found
        return found

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        found = None
        for segment in segments:
            for n, tails in node.get("tails", {}).items():
                if n <= len(segment) and (rule := tails.get(segment[:n])) is not None:
                    found = rule
                    break
            node = node.get(("step", segment))
            if node is None:
                break
        return found


def _better(a: Rule | None, b: Rule | None) -> Rule | None:
    """Of two rules that fit one url the one that decides: most labels, longest path, block."""
    return max((r for r in (a, b) if r), key=lambda r: (r.host.count("."), len(r.path), r.verdict == BLOCK), default=None)


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", default: str = ALLOW, most_rules: int = MAX_RULES) -> DataFrame:
    """``pages`` with host, path, rule (the one that decides, or null) and verdict of each url.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest match wins, by host
    labels first and by path next; on a tie block wins. Where no rule fits the verdict is ``default``.

    A broadcast trie has at most ``most_rules`` rules. More are split, and the tries judge the pages one after the other,
    each result written and read again, the better of both rules kept: memory stays bounded and every rule counts.

    Defined cases: null and odd urls have empty host and path, which no rule with a host fits; repeated rows are judged
    each; very long urls are judged whole; an empty table gives no rows, no rules the default. All columns are kept; of the
    new ones those whose names are taken get underscores (free_name).
    """
    parts = [rules[i : i + most_rules] for i in range(0, len(rules), most_rules)] or [[]]
    names, extra, columns = ("host", "path", "rule", "verdict"), [], pages.columns
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        fields = [T.StructField(n, T.StringType()) for n in (names if last else ("best",))]
        pages = append_columns(pages, url, fields, _judging(pages, part, default, last), also=extra)
        if not last:
            pages = written(pages, "judged")
            extra = [pages.columns[-1]]
    return pages.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`") for c in pages.columns[-len(names) :]])


def _judging(pages: DataFrame, rules: list[Rule], default: str, last: bool):
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def make():
        trie = shared.value

        def compute(urls: list, before: list | None = None) -> list[pa.Array]:
            parts = [split_url(u) for u in urls]
            found = [trie.match(h, p) if h else None for h, p in parts]
            if before is not None:
                found = [_better(r, Rule(*json.loads(b)) if b else None) for r, b in zip(found, before, strict=True)]
            if not last:
                return [pa.array([json.dumps(r) if r else None for r in found], pa.string())]
            return [
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([r.name if r else None for r in found], pa.string()),
                pa.array([r.verdict if r else default for r in found], pa.string()),
            ]

        return compute

    return make

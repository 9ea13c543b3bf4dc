"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive, by the kind of block
they stand in, and tags negative; the weights are log odds counted, by Spark, over
the labelled pages, those whose markup names the article (``article`` or ``main``).
One linear scan finds the contiguous region with the largest sum. Elements that are
never article text (menus, forms, asides, ...) are known by their tag; their words do
not count and are left out also inside the region, unless they hold an ``article`` or
``main``. Roles, classes and ids (comments, notices, ...) leave nothing out: the words
of such elements have weights of their own, learned for each listed name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.tables import quoted

# HTML element names by their use.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del",
          "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BLOCKS = {"article", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main",
          "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
LABELS = {"article", "main"}
SKIPPED = {"head", "nav", "footer", "header", "aside", "form", "menu", "dialog", "button",
           "select", "object", "audio", "video", "canvas"} | RAW
SKIPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert",
                 "dialog", "menu", "menubar", "form"}
SKIPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo",
    "promotion", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "topbar", "widget"}
# A label element is entered or left at this cost; other tags cost at least the least cost.
LABEL_COST = 50.0
LEAST_COST = 0.01
LEAST_GAIN = 0.05
UNSEEN = {"word": 1.0, "named": -1.0, "tag": -0.2}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W_]+")


def listed_name(attributes: str) -> str:
    """The first listed name in a role, class or id, or "".

    A whole value counts: all of its parts must be listed, as in ``cookie-notice``.
    """
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in ("class", "id", "role"):
            continue
        names = SKIPPED_ROLES if key == "role" else SKIPPED_NAMES
        for token in value.strip("\"'").split():
            parts = [p.lower() for p in NAME.findall(token)]
            if parts and all(p in names for p in parts):
                return parts[0]
    return ""


def tokens_of(page: str) -> list[tuple[str, bool, str]]:
    """``(tag name, is end tag, attributes)`` and ``("", False, text)`` in page order."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                out.append(("", False, m[0]))
            continue
        ends = bool(m[1] or m[5])
        if name in RAW and not ends:  # its content is not markup
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        out.append((name, ends, m[3] or ""))
    return out


def _ends(tokens: list) -> dict[int, int]:
    """By the place of a start tag the place after its end tag, where it has one."""
    ends, opened = {}, {}
    for i, (name, is_end, _) in enumerate(tokens):
        if not name or name in VOID:
            continue
        if not is_end:
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            ends[opened[name].pop()] = i + 1
    return ends


def without_skipped(tokens: list) -> list[tuple[str, bool, str, bool, str]]:
    """The tokens, each with whether it is left out and with the listed name it stands under.

    An element ends at its end tag; one without an end tag ends with its own tag,
    except ``head``, which ends where the body begins. An element that is or holds a
    label is neither left out nor named; inside others the innermost name counts.
    """
    n, ends = len(tokens), _ends(tokens)
    labels = [0]
    for name, is_end, _ in tokens:
        labels.append(labels[-1] + (name in LABELS and not is_end))
    out, at, under = [], 0, []
    while at < n:
        name, is_end, rest = tokens[at]
        while under and under[-1][0] <= at:
            under.pop()
        if name and not is_end and name not in VOID:
            end = ends.get(at, at + 1)
            if name == "head":
                stop = ends.get(at, n)
                end = next((i for i in range(at + 1, stop) if tokens[i][0] == "body"), stop)
            if labels[end] == labels[at]:
                if name in SKIPPED:
                    out.extend((*t, True, "") for t in tokens[at:end])
                    at = end
                    continue
                if rest and name not in ("html", "body") and (found := listed_name(rest)):
                    under.append((min(end, under[-1][0]) if under else end, found))
        out.append((name, is_end, rest, False, under[-1][1] if under else ""))
        at += 1
    return out


def without_names(tokens: list, everywhere: bool = False) -> list:
    """The tokens without the names inside labels, as a label tells more, or without any."""
    out, depth = [], 0
    for name, is_end, rest, skipped, named in tokens:
        if name in LABELS and not skipped:
            depth = max(0, depth + (-1 if is_end else 1))
        out.append((name, is_end, rest, skipped, "" if everywhere or depth else named))
    return out


def _kind(name: str) -> str:
    return name if name in BLOCKS or name in INLINE else "other"


def features_of(tokens: list) -> list[tuple[str, int]]:
    """Per token its feature and how many words it has (0 for tags)."""
    out, block, links = [], "body", 0
    for name, ends, rest, _, named in tokens:
        if name:
            if name == "a":
                links = max(0, links + (-1 if ends else 1))
            elif name not in INLINE:
                block = "body" if ends else _kind(name)
            out.append((("/" if ends else "") + _kind(name), 0))
        else:
            feature = f"named {named}" if named else f"word {block}{' link' if links else ''}"
            out.append((feature, len(rest.split())))
    return out


def count_features(page: str) -> Counter:
    """Words and tags of a labelled page by feature, inside and outside its article."""
    found: Counter = Counter()
    tokens = without_skipped(tokens_of(page))
    if not any(name in LABELS and not skipped for name, _, _, skipped, _ in tokens):
        return found
    depth = 0
    for (name, ends, _, skipped, _), (feature, n) in zip(tokens, features_of(tokens)):
        if name in LABELS:
            depth = max(0, depth + (-1 if ends else 1))
        elif not skipped:
            found[feature, depth > 0] += n or bool(name)
    return found


def learned_weights(counts: list[tuple[str, bool, int]]) -> dict[str, float]:
    """Log odds of standing inside the article, smoothed.

    Words are held above and tags below zero; words under a listed name have theirs as it is.
    """
    both: dict[str, list[int]] = {}
    for feature, inside, n in counts:
        both.setdefault(feature, [0, 0])[inside] += n
    weights = {}
    for feature, (outside, inside) in both.items():
        odds = math.log((inside + 1) / (outside + 1))
        if feature.startswith("named "):
            weights[feature] = odds
        else:
            is_word = feature.startswith("word ")
            weights[feature] = max(LEAST_GAIN, odds) if is_word else min(-LEAST_COST, odds)
    for name in LABELS:
        weights[name] = weights["/" + name] = -LABEL_COST
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, by one scan; the longest of equals."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def scores_of(tokens: list, weights: dict[str, float]) -> list[float]:
    scores = []
    for (name, _, _, skipped, named), (feature, n) in zip(tokens, features_of(tokens)):
        if name:
            scores.append(weights.get(feature, UNSEEN["tag"]))
        else:
            unseen = UNSEEN["named" if named else "word"]
            scores.append(0.0 if skipped else n * weights.get(feature, unseen))
    return scores


def extract(page: str, weights: dict[str, float]) -> str:
    """The main text of a page; empty for a page without words outside skipped elements.

    If all words stand under names that tell against them, the names do not count.
    """
    tokens = without_names(without_skipped(tokens_of(page)))
    low, high = best_region(scores_of(tokens, weights))
    if low == high:
        low, high = best_region(scores_of(without_names(tokens, everywhere=True), weights))
    blocks, parts = [], []
    for name, _, rest, skipped, _ in tokens[low:high]:
        if not name:
            if not skipped:
                parts.append(rest)
        elif name not in INLINE:
            blocks.append("".join(parts))
            parts = []
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name == "br" else "")
    blocks.append("".join(parts))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def weights_from(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages; features are few fixed names, so is the result."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                if isinstance(page, str):
                    total.update(count_features(page))
        yield pd.DataFrame(
            [(feature, inside, n) for (feature, inside), n in total.items()],
            columns=["feature", "inside", "n"])

    rows = pages.select(quoted(html_column).alias("html")).mapInPandas(
        count, "feature string, inside boolean, n long")
    summed = rows.groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return learned_weights([tuple(r) for r in summed.collect()])


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None,
               id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
               ) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    NULL and empty pages, and pages without words, have an empty text. Repeated
    rows give repeated results, other columns are not looked at.
    """
    found = weights_from(pages, html_column) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(p, found) if isinstance(p, str) else "" for p in batch.pop("html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    rows = pages.select(quoted(id_column).cast("string").alias("page_id"),
                        quoted(url_column).alias("url"), quoted(html_column).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))

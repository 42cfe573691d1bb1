"""Personal data: rules for four kinds, and a skip-chain conditional random field over what looks like them.

The rules give the base spans. The field labels the tokens of a document that hold a digit or an at sign; all other tokens are
outside by definition of the model, so they part the chain. Neighbouring tokens share a transition potential. Tokens of equal form,
anywhere in the document, share a skip potential through a variable of that form: what is a phone number in one place is one in the others,
however many repeats lie between. Tokens that the rules found are evidence, for themselves and for their form. Loopy message passing gives
marginals; confident tokens make added spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import as_bytes, inputs, row_share, small_batches, stage

# The kinds in the order of their report.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0
LABELS = 1 + len(KINDS)

#: documents that the field is fitted on, at most (in expectation), and bytes of their texts, in the order of their hashes
MAX_ROWS, MAX_BYTES = 8_000, 64 << 20
#: probability of its label from which an unexplained token becomes a span
CONFIDENT = 0.9
#: other tokens whose looks a repeated token is given in training
LOOKS = 8
#: rounds of messages, unless there are more variables, which evidence may have to pass one by one
ROUNDS = 50

# Character classes of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DOTTED = r"[0-9]+(?:\.[0-9]+)*"
DIGITS = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WHITE = frozenset("\x20\t\n\x0b\x0c\r")

Span = tuple[int, int, int]  # start, end, index of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def find_emails(text: str, domain=re.compile(DOMAIN)) -> Iterator[Span]:
    """Goes from one at sign to the next, so a long run of local characters is passed once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = domain.match(text, at) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done, 0
        at = text.find("@", done)


def find_ips(text: str, dotted=re.compile(DOTTED)) -> Iterator[Span]:
    """Takes whole dotted sequences and cuts them in fours, which is what a search from the left finds in them."""
    for match in dotted.finditer(text):
        if match[0].count(".") < 3:
            continue
        ends = [m.span() for m in re.finditer("[0-9]+", match[0])]
        for i in range(0, len(ends) - 3, 4):
            parts = [match[0][a:b].lstrip("0") or "0" for a, b in ends[i : i + 4]]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                yield match.start() + ends[i][0], match.start() + ends[i + 3][1], 1


def find_cards(text: str, digits=re.compile(DIGITS)) -> Iterator[Span]:
    for match in digits.finditer(text):
        if match.end() - match.start() >= 14:
            number = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                yield match.start(), match.end(), 2


def find_phones(text: str, phone=re.compile(PHONE)) -> Iterator[Span]:
    for match in phone.finditer(text):
        if 10 <= sum(c in "0123456789" for c in match[0]) <= 15:
            yield match.start(), match.end(), 3


def base_spans(text: str) -> list[Span]:
    """Base spans of all kinds, by start and then kind. Each kind is searched by itself and may overlap others."""
    spans = [*find_emails(text), *find_ips(text), *find_cards(text), *find_phones(text)]
    return sorted(spans, key=lambda span: (span[0], span[2]))


def tokens(text: str, mark=re.compile("[0-9@]")) -> list[tuple[int, int]]:
    """Places of the tokens (words between ASCII white space, without quotes and closing marks around them) that hold a digit or an at sign."""
    found, done = [], 0
    match = mark.search(text)
    while match:
        start, end = match.start(), match.end()
        while start > done and text[start - 1] not in WHITE:
            start -= 1
        while end < len(text) and text[end] not in WHITE:
            end += 1
        done = end
        while end > match.end() and text[end - 1] in ".,;:!?\"'>]}":
            end -= 1
        while start < match.start() and text[start] in "\"'<[{":
            start += 1
        found.append((start, end))
        match = mark.search(text, done)
    return found


#: features of a token, in this order; the last ones tell whether a rule's check holds, and are hidden at times in training
FEATURES = (
    "bias", "at", "plus", "paren", "letters", "equals", "dots3", "dash", "digits1", "digits3", "digits4", "digits7", "digits10",
    "digits14", "digits20", "long", "only_digits", "after_token", "after_plus", "before_token",
    "octets", "luhn", "domain",
)
CHECKS = 3


def token_features(text: str, places: list[tuple[int, int]]) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """``(features, keys, joined)``: rows of ``FEATURES``; the form by which tokens are alike, if any; whether the next token follows at once."""
    rows, keys, joined = [], [], []
    for i, (start, end) in enumerate(places):
        token = text[start:end]
        digits = "".join(c for c in token[:64] if c in "0123456789")
        count = sum(c in "0123456789" for c in token) if end - start > 64 else len(digits)
        after = i > 0 and start - places[i - 1][1] <= 2
        before = i + 1 < len(places) and places[i + 1][0] - end <= 2
        letters = any(c.isalpha() for c in token)
        parts = token.split(".") if end - start < 32 else []
        rows.append(
            (
                1, "@" in token, token[0] == "+", token[0] == "(", letters, "=" in token, token.count(".") == 3, "-" in token,
                count <= 2, count == 3, 4 <= count <= 6, 7 <= count <= 9, 10 <= count <= 13, 14 <= count <= 19, count >= 20,
                end - start > 32, count == end - start, after, after and text[places[i - 1][0]] == "+", before,
                len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
                14 <= count <= 19 and not letters and luhn(digits),
                bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]", token)) if "@" in token else False,
            )
        )
        if "@" in token:
            keys.append(token.lower())
        elif count >= 5 and not letters:
            keys.append("".join(c for c in token if c in "0123456789"))
        else:
            keys.append(None)
        joined.append(before)
    return np.array(rows, float).reshape(len(places), len(FEATURES)), keys, np.array(joined, bool)


def evidence(places: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """Label that the base spans give each token, -1 where none overlaps it. Both lists are in order of their starts."""
    known = np.full(len(places), -1)
    first = 0
    for i, (start, end) in enumerate(places):
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        at = first
        while at < len(spans) and spans[at][0] < end:
            if spans[at][1] > start:
                known[i] = 1 + spans[at][2]
                break
            at += 1
    return known


def form_groups(keys: list[str | None]) -> list[list[int]]:
    """Tokens of equal form, for the forms that occur more than once: each group is joined to one variable, not all its pairs."""
    groups: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        if key is not None:
            groups.setdefault(key, []).append(i)
    return [group for group in groups.values() if len(group) > 1]


def form_label(known: list[int]) -> int:
    """What the evidence says of a form: the kind that most of its tokens have, the first on ties; -1 without evidence."""
    kinds = [label for label in known if label > OUTSIDE]
    return max(dict.fromkeys(kinds), key=kinds.count) if kinds else -1


@dataclass
class SkipChainField:
    """Log potentials: of features and labels, of neighbouring labels, and of a token having the label of its form."""

    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels

    def marginals(self, values: np.ndarray, known: np.ndarray, chain: np.ndarray, forms: list[list[int]]) -> np.ndarray:
        """Marginals of the tokens by loopy belief propagation, all messages at once, until they hardly change.

        Each form in ``forms`` is one more variable, joined to its tokens; evidence for one of them is evidence for the form.
        """
        count = len(values)
        nodes = np.vstack((values @ self.unary, np.zeros((len(forms), LABELS))))
        known = np.concatenate((known, [form_label(known[group].tolist()) for group in forms])).astype(int)
        skip = np.array([(i, count + form) for form, group in enumerate(forms) for i in group], int).reshape(-1, 2)
        fixed = known >= 0
        nodes[fixed] = -1e9
        nodes[fixed, known[fixed]] = 0
        edges = np.concatenate((chain, skip)) if len(chain) + len(skip) else np.empty((0, 2), int)
        if not len(edges):
            return _normal(nodes[:count])
        tables = np.concatenate(
            (np.broadcast_to(self.chain, (len(chain), LABELS, LABELS)), np.broadcast_to(np.diag(self.skip), (len(skip), LABELS, LABELS)))
        )
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        messages = np.zeros((len(source), LABELS))
        for _ in range(max(ROUNDS, len(nodes))):
            belief = nodes.copy()
            np.add.at(belief, target, messages)
            sent = (belief[source] - messages[back])[:, :, None] + tables
            top = sent.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(sent - top).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(np.maximum(new, -50) - np.maximum(messages, -50)).max()
            messages = 0.5 * (messages + new) if change > 1e-4 else new
            if change <= 1e-4:
                break
        belief = nodes.copy()
        np.add.at(belief, target, messages)
        return _normal(belief[:count])

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and added spans of a text."""
        base = base_spans(text)
        places = tokens(text)
        known = evidence(places, base)
        open_tokens = np.flatnonzero(known < 0)
        if not len(open_tokens):
            return base, []
        values, keys, joined = token_features(text, places)
        chain = np.flatnonzero(joined)
        chance = self.marginals(values, known, np.stack((chain, chain + 1), axis=1), form_groups(keys))
        added: list[Span] = []
        for i in open_tokens:
            kind = int(chance[i].argmax())
            if kind != OUTSIDE and chance[i, kind] >= CONFIDENT:
                start, end = places[i]
                if added and added[-1][2] == kind - 1 and joined[i - 1] and added[-1][1] == places[i - 1][1]:
                    added[-1] = (added[-1][0], end, kind - 1)
                else:
                    added.append((start, end, kind - 1))
        return base, added


def _normal(scores: np.ndarray) -> np.ndarray:
    chance = np.exp(scores - scores.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def fit_field(texts: list[str], steps: int = 400, rate: float = 0.2, decay: float = 0.003) -> SkipChainField:
    """Pseudo-likelihood: each token's label given its features, the labels of its neighbours, and that of its form.

    The labels come from the base rules, and by form: where a rule finds a token, all tokens of that form in the document have its kind, also
    those that the rule misses. Every token is seen as it is, and without the features that repeat a rule's check, so that the field
    leans on form and neighbours as well. Tokens of repeated forms are seen once more without any features, as one whose rule and
    looks are hidden: there the label of the form is all that tells. So the skip potentials learn how far repeats agree.
    """
    values, labels, forms, chain = [], [], [], []
    size = 0
    for text in texts:
        places = tokens(text)
        if not places:
            continue
        found, keys, joined = token_features(text, places)
        known = evidence(places, base_spans(text))
        own, form = np.maximum(known, OUTSIDE), np.full(len(places), -1)
        for group in form_groups(keys):
            label = max(form_label(known[group].tolist()), OUTSIDE)
            form[group] = label
            own[group] = np.where(known[group] < 0, label, own[group])
        values.append(found)
        labels.append(own)
        forms.append(form)
        chain += [(size + i, size + i + 1) for i in np.flatnonzero(joined)]
        size += len(places)
    if not size:
        nothing = np.zeros((len(FEATURES), LABELS))
        nothing[0, OUTSIDE] = 10.0
        return SkipChainField(nothing, np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    x, y, form = (np.concatenate(parts) for parts in (values, labels, forms))
    truth = np.eye(LABELS)[y]
    chain = np.array(chain, int).reshape(-1, 2)
    before, after = np.zeros_like(truth), np.zeros_like(truth)
    np.add.at(before, chain[:, 1], truth[chain[:, 0]])
    np.add.at(after, chain[:, 0], truth[chain[:, 1]])
    repeated = np.flatnonzero(form >= 0)
    alike = np.zeros_like(truth)
    alike[repeated, form[repeated]] = 1
    unchecked = x.copy()
    unchecked[:, -CHECKS:] = 0
    drawn = np.tile(repeated, LOOKS)
    looks = x[np.random.default_rng(len(x)).integers(len(x), size=len(drawn))]
    form_truth = np.eye(LABELS)[form[drawn]]
    among = np.bincount(form[drawn], minlength=LABELS)
    share = 1 / np.maximum(among[form[drawn]] * (among > 0).sum(), 1)[:, None]
    x, truth = np.concatenate((x, unchecked)), np.concatenate((truth, truth))
    before, after, alike = (np.concatenate((m, m)) for m in (before, after, alike))
    unary, pair, same = np.zeros((len(FEATURES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    speed = [np.full_like(w, 1e-8) for w in (unary, pair, same)]
    for _ in range(steps):
        error = (_normal(x @ unary + before @ pair + after @ pair.T + alike * same) - truth) / len(x)
        hidden = (_normal(looks @ unary + form_truth * same) - form_truth) * share
        for w, total, slope in zip(
            (unary, pair, same),
            speed,
            (x.T @ error, before.T @ error + error.T @ after, (form_truth * hidden).sum(axis=0)),
        ):
            slope = slope + decay * w / len(x) ** 0.5
            total += slope * slope
            w -= rate * slope / np.sqrt(total)
    if (among > 0).any():  # a label that no repeated form has agrees as well as the others
        same[among == 0] = same[among > 0].mean()
    return SkipChainField(unary, pair, same)


def train_field(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> SkipChainField:
    """A field fitted on about ``max_rows`` documents at most, drawn by a hash of the id from those that hold a digit or an at sign.

    One task fits it, in the order of the hash, so it does not depend on the layout, and stops before ``MAX_BYTES`` of texts are exceeded; the
    potentials, under 200 numbers, go to the driver.
    """
    rows = inputs(df, doc_id=id_col, text=text_col).filter(F.col("text").rlike("[0-9@]"))
    count = rows.count()
    sample = rows.filter(row_share(F.col("doc_id"), min(1.0, max_rows / max(count, 1)), "pii"))
    sample = stage(sample.select(F.xxhash64("doc_id").alias("turn"), as_bytes(F.col("text")).alias("text")), "pii-sample")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[str] = []
        held = 0
        for batch in batches:
            for text in batch["text"]:
                held += len(text)
                if held <= MAX_BYTES or not kept:
                    kept.append(bytes(text).decode("utf-8", "replace"))
        field = fit_field(kept)
        flat = np.concatenate((field.unary.ravel(), field.chain.ravel(), field.skip))
        yield pd.DataFrame({"place": np.arange(len(flat)), "weight": flat})

    ordered = small_batches(sample).repartition(1).sortWithinPartitions("turn", "text")
    fitted = ordered.mapInPandas(fit, "place bigint, weight double").toPandas().sort_values("place")
    flat = fitted["weight"].to_numpy()
    if not len(flat):
        return fit_field([])
    one, two = len(FEATURES) * LABELS, len(FEATURES) * LABELS + LABELS * LABELS
    return SkipChainField(flat[:one].reshape(-1, LABELS), flat[one:two].reshape(LABELS, LABELS), flat[two:])


def find_personal_data(
    df: DataFrame, field: SkipChainField, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, spans)`` per row: all spans of the whole text as structs ``(kind, start, end, base)`` by start, then kind.

    Places are code points, the end exclusive; ``base`` tells the rules' spans from those that the field adds, which never overlap
    a base span. NULL and empty texts have none. Rows are independent: no shuffle, and time in proportion to the text.
    """
    rows = inputs(df, doc_id=id_col, text=text_col).select("doc_id", as_bytes(F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for data in batch["text"]:
                base, added = field.spans(bytes(data).decode("utf-8", "replace"))
                every = [(*span, True) for span in base] + [(*span, False) for span in added]
                every.sort(key=lambda span: (span[0], span[2]))
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in every])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": found})

    return small_batches(rows).mapInPandas(
        run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
    )

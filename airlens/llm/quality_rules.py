"""Line-first cleaning of documents: rules drop lines, and documents that lose too much are rejected."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame

from airlens.llm import work

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of menus and link lists.
SEPARATORS = "|>»›•·→"
#: Phrases of page furniture and licences in several languages, in lower case. Fixed values.
PHRASES = (
    "all rights reserved", "licensed under", "copyright", "privacy policy", "cookie", "cookies", "terms of use", "terms of service", "javascript", "click here", "read more",
    "sign up", "log in", "sign in", "subscribe", "share on", "follow us",
    "alle rechte vorbehalten", "urheberrecht", "impressum", "nutzungsbedingungen", "mehr lesen", "weiterlesen", "jetzt anmelden",
    "tous droits réservés", "mentions légales", "conditions d utilisation", "lire la suite", "se connecter",
    "todos los derechos reservados", "aviso legal", "leer más", "iniciar sesión",
)
#: A phrase fails a line of so many words at most, or one of which its words are so large a part.
SHORT_LINE, PHRASE_PART = 12, 8
#: As words stand in ``_spelled``: two spaces between words, one at each end of a phrase.
_PADDED = [(" " + "  ".join(p.split()) + " ", len(p.split())) for p in PHRASES]
_RAREST = sorted({max(p.split(), key=len) for p in PHRASES})
_BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")
LOWER, UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
ENDING = regex.compile(r"[.!?…:;][\"'”’»)\]]*$")
WINDOW = 8


def passes(line: str, words: list[str]) -> bool:
    """Whether a line with words holds under the rules that look at it alone.

    Punctuation: under 8 words without a closing mark is a fragment, and so is a line of 4 words or more in capitals.
    Navigation: a separator for every 4 words. Boilerplate: ``furniture``. Noise: 3 symbols for every 10 words, or 3 of
    10 words (of 4 at least) that repeat the word before them.
    """
    n = len(words)
    if n < 8 and not ENDING.search(words[-1]):
        return False
    if n >= 4 and not LOWER.search(line) and UPPER.search(line):
        return False
    if 4 * sum(map(line.count, SEPARATORS)) >= n or 10 * sum(map(line.count, SYMBOLS)) >= 3 * n:
        return False
    if n >= 4 and 10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > 3 * n:
        return False
    return not furniture(line, n)


def furniture(line: str, n: int) -> bool:
    """Whether known phrases make a line of ``n`` words page furniture: it is short, or they are an eighth of it.

    Phrases are whole words, whatever stands between them, so prose that mentions one is left alone.
    """
    low = line.lower()
    if not any(w in low for w in _RAREST):
        return False
    spelled = "  " + _BETWEEN.sub("  ", low) + "  "
    words = sum(spelled.count(p) * size for p, size in _PADDED)
    return words > 0 and (n <= SHORT_LINE or PHRASE_PART * words >= n)


def split_words(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in work.raw(text).split()]


def size_of(text: str) -> int:
    """Characters in words."""
    return len(text) - sum(map(text.count, SPACES))


def repeated_words(text: str) -> int:
    """Words in windows of 8 words that stand twice or more in the text, the first included."""
    h = work.windows_of(work.hashes_of(work.words_of(work.raw(text))), WINDOW)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(h) + WINDOW, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def judge(text: str | None) -> dict:
    """All columns of one text, and the text that is left of it."""
    text = text or ""
    seen: set[str] = set()
    kept: list[str] = []
    n_words = n_dup = lost = 0
    for line in text.split("\n"):
        words = split_words(line)
        if not words:
            kept.append(line)
            continue
        n_words += len(words)
        again = line in seen
        n_dup += again
        seen.add(line)
        if again or not passes(line, words):
            lost += size_of(line)
        else:
            kept.append(line)
    chars, repeats = size_of(text), repeated_words(text)
    base_failed = n_words < 20 or 100 * repeats > 30 * n_words
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and 2 * lost <= chars,
        "lost_chars": lost,
        "cleaned": "\n".join(kept),
    }


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint"


def quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Counts and verdict of every row of ``docs(doc_id, text)``; ``with_text`` adds ``cleaned``, the lines that passed.

    Each line is judged by ``passes``; a line equal to an earlier one of its text fails too, and lines without words are
    left alone. A document is kept if it has 20 words or more, at most 30 % of its words stand in repeated windows, and
    its failed lines hold at most half of its characters in words. Null text: no words, rejected. Rows are judged one by
    one, so repeated rows and null ids come out as they are; other columns are ignored.
    """

    def run(ids, texts):
        found = [judge(t) for t in texts]
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["cleaned"] * with_text
        return {"doc_id": ids} | {n: [f[n] for f in found] for n in names}

    return work.map_batches(docs, run, f"doc_id bigint, {COLUMNS}" + ", cleaned string" * with_text, "doc_id", "text")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the lines that passed as their text; all columns stay, n_chars follows.

    A null text is rejected, as every text under 20 words.
    """

    def run(texts):
        found = [judge(t) for t in texts]
        return [f["kept"] for f in found], [f["cleaned"] for f in found]

    return work.select_rows(docs, run)


_COUNTED = " + ".join(f"{size} * ((length(spelled) - length(replace(spelled, '{p}', ''))) // {len(p)})" for p, size in _PADDED)
#: The same verdicts in SQL (RE2 patterns), for tables of moderate size.
SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM doc),
gram AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM word)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
line AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM cut),
worded AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM line WHERE len(w) > 0),
phrased AS (SELECT *, {_COUNTED} AS furniture FROM (SELECT *, '  ' || regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', '  ', 'g') || '  ' AS spelled FROM worded)),
judged AS (
  SELECT doc_id, n, again, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS size,
    again
    OR (n < 8 AND NOT regexp_matches(w[n], '[.!?…:;]["''”’»)\]]*$'))
    OR (n >= 4 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
    OR 4 * length(regexp_replace(line, '[^|>»›•·→]', '', 'g')) >= n
    OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= 3 * n
    OR (n >= 4 AND 10 * len(list_filter(range(2, n + 1), lambda k: w[k] = w[k - 1])) > 3 * n)
    OR (furniture > 0 AND (n <= {SHORT_LINE} OR {PHRASE_PART} * furniture >= n)) AS failed
  FROM phrased),
total AS (SELECT doc_id, sum(n) AS n_words, sum(size) AS word_chars, sum(again::INT) AS n_dup_lines, sum(CASE WHEN failed THEN size ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
base AS (
  SELECT doc.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM doc LEFT JOIN total USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept, lost_chars
FROM base
"""

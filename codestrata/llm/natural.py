"""Natural language in comments and string literals: segments, their language, and their share of the file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import source_files
from codestrata.sources.tables import project_files
from codestrata.llm.lexers import plain_text, text_pieces
from codestrata.session import python_rows

NATURAL = ("en", "zh", "de", "fr", "es", "ru", "ja")
#: Running text has so many words, or so many Chinese or Japanese characters.
LEAST_WORDS, LEAST_CJK = 5, 8
#: Hash buckets of character n-grams (one to three characters); with seven languages the model is under 1 MB.
BUCKETS = 1 << 14

# How documents spell their declared language.
DECLARED = {
    "en": "en eng english en-us en-gb en_us", "zh": "zh zho chi cn chinese zh-cn zh_cn zh-hans", "de": "de deu ger german de-de",
    "fr": "fr fra fre french fr-fr", "es": "es spa spanish es-es", "ru": "ru rus russian ru-ru", "ja": "ja jpn jp japanese ja-jp",
}

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_CJK_RUN = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_WORD_TOKEN = re.compile(r"^[\"'“”«»„(¿¡\[]*[^\W\d_]+(?:['’‑-][^\W\d_]+)*['’]?[\"'“”«».,;:!?…)\]]*$")
# Upper-case words of query languages.
_QUERY = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE|JOIN|VALUES|GROUP BY|ORDER BY|INTO|SET|TABLE)\b")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\w.$]+\s*\(|\w\(\w*[,)]|[=!<>]=|=>|->|::|&&|\|\||\w+\.\w+\(|^\s*[\w.]+\s*[-+*/]?=\s*\S|</?\w+[^>]*>\s*$|\\[wdsb]")
_TAG = re.compile(r"^\s*(?:[:@\\](?:param|return|returns|raises|throws|type|rtype|see|since|author|arg|brief)\b.*)$")
_MARKUP = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^>\n]*)?>|\{@\w+[^}]*\}|`[^`\n]*`|https?://\S+|[\w.-]+@[\w.-]+")


def running_text(line: str) -> str | None:
    """The line without markup, if it holds running text."""
    if line.isascii() and line.count(" ") < LEAST_WORDS - 1 and len(line.split()) < LEAST_WORDS:
        return None
    if _TAG.match(line):
        return None
    if len(_QUERY.findall(line)) >= 2 or _CODE.search(line):
        return None
    text = _MARKUP.sub(" ", line)
    cjk = len(_CJK.findall(text))
    if cjk >= LEAST_CJK:
        return text
    parts = text.split()
    spoken = [p for p in parts if _WORD_TOKEN.match(p) and not _CJK.search(p)]
    if len(spoken) >= LEAST_WORDS and len(spoken) >= 0.6 * len(parts):
        return text
    return None


def _lines(kind: str, body: str, language: str) -> list[str]:
    """The text lines of one comment or string literal, without marks and quotes."""
    if kind == "comment":
        body = re.sub(r"^\s*(?:/\*+!?|//+!?|\#+!?)|\*+/\s*$", "", body)
    else:
        body = re.sub(r"^[A-Za-z@$]{0,3}\#*(\"\"\"|'''|[\"'`])", "", body)
        body = re.sub(r"(\"\"\"|'''|[\"'`])\#*$", "", body)
        body = body.replace("\\n", "\n").replace("\\t", " ")
    return [re.sub(r"^\s*\*+(?!\*)\s?", "", line) if kind == "comment" else line for line in body.split("\n")]


def _paragraphs(lines: list[str]) -> Iterator[str]:
    """Lines that hold running text by themselves, and neighbouring shorter ones joined."""
    short: list[str] = []
    for line in [*lines, ""]:
        alone = running_text(line)
        if alone is not None:
            yield from _joined(short)
            short = []
            yield alone
        elif not line.strip() or _TAG.match(line) or _CODE.search(line):
            yield from _joined(short)
            short = []
        else:
            short.append(line.strip())
    yield from _joined(short)


def _joined(short: list[str]) -> Iterator[str]:
    if len(short) > 1:
        text = running_text(" ".join(short))
        if text is not None:
            yield text


_CODE_SIGN = re.compile(r"[(){}\[\];=]")
# How a line of markup begins, and the words that follow # in sources.
_MARKUP_START = ("<!", "<?", "</", "<html", "<head", "<body", "<div", "<p")
_HASH_WORDS = re.compile(r"#\s*(?:\[|!|include|define|if|end|pragma|el|undef|error|warning|import|line|region|nullable)")


def is_source(text: str, pieces: list[tuple[str, str, int]], language: str = "") -> bool:
    """Whether the lines outside comments and strings read as code, not as prose or markup; scripts may hold markup."""
    markup = () if language in ("javascript", "typescript") and not text.lstrip().startswith(("<!", "<?", "<html")) else _MARKUP_START
    gaps, last = [], 0
    for _, body, at in pieces:
        gaps.append(text[last:at])
        last = at + len(body)
    gaps.append(text[last:])
    lines = [line for line in map(str.strip, " ".join(gaps).split("\n")) if line]
    if not lines:
        return True
    foreign = 0
    for line in lines:
        if line.startswith(markup) or (line.startswith(("#", "* ", "- ")) and not _HASH_WORDS.match(line)):
            foreign += 1
        elif not _CODE_SIGN.search(line) and (line.count(" ") >= LEAST_WORDS - 1 or not line.isascii()):
            parts = line.split()
            spoken = sum(1 for p in parts if _WORD_TOKEN.match(p))
            if (spoken >= LEAST_WORDS and spoken >= 0.7 * len(parts)) or len(_CJK.findall(line)) >= LEAST_CJK:
                foreign += 1
    return foreign * 3 < len(lines)


def segments(content: str, language: str) -> list[str]:
    """Running text in the comments and string literals of a source file."""
    text = plain_text(content)
    pieces = text_pieces(text, language)
    if not pieces or not is_source(text, pieces, language):
        return []
    out: list[str] = []
    block: list[str] = []
    last_end = None
    for kind, body, at in pieces:
        if kind == "string":
            if block:
                out += _paragraphs(block)
                block = []
            last_end = None
            if "\n" in body or "\\n" in body or not body.isascii() or body.count(" ") >= LEAST_WORDS - 1:
                out += _paragraphs(_lines(kind, body, language))
            continue
        near = last_end is not None and text.count("\n", last_end, at) == 1 and not text[last_end:at].strip()
        if block and not near:
            out += _paragraphs(block)
            block = []
        block += _lines(kind, body, language)
        last_end = at + len(body)
    if block:
        out += _paragraphs(block)
    return out


# -- identification by naive Bayes over character n-grams


_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Documents of which letters make up less than this teach nothing about a language.
LEAST_LETTERS = 0.7


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the one- to three-character n-grams of a text."""
    return _buckets(_NO_LETTERS.sub(" ", text.lower()))


def _buckets(low: str) -> np.ndarray:
    c = np.frombuffer(f" {low.strip()} ".encode("utf-32-le"), dtype=np.uint32)
    one = c[1:-1] * np.uint32(2654435761)
    two = c[:-1] * np.uint32(40503) + c[1:] * np.uint32(2246822519)
    three = c[:-2] * np.uint32(3266489917) + c[1:-1] * np.uint32(668265263) + c[2:] * np.uint32(374761393)
    h = np.concatenate([one, two, three])
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def declared_language(lang):
    """The declared language of a document as one of NATURAL, else null."""
    names = {alias: code for code, aliases in DECLARED.items() for alias in aliases.split()}
    spelled = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return spelled[F.lower(F.trim(lang))]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = np.zeros((len(NATURAL), BUCKETS), dtype=np.int64)
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["code"]):
            low = _NO_LETTERS.sub(" ", text.lower())
            if len(low) >= LEAST_LETTERS * len(text) > 0:
                table[NATURAL.index(lang)] += np.bincount(_buckets(low), minlength=BUCKETS)
    at = np.nonzero(table)
    yield pd.DataFrame({"lang": at[0].astype(np.int32), "bucket": at[1].astype(np.int32), "n": table[at]})


def fit_languages(documents: DataFrame) -> np.ndarray:
    """Log probabilities (language by bucket) from all documents with a known declared language.

    Tasks count n-grams into a fixed table and Spark sums the tables, so the
    driver receives at most 7 * BUCKETS rows however many documents there are.
    Wrong labels only blur the counts.
    """
    rows = documents.where("text is not null").select("text", declared_language(F.col("lang")).alias("code")).where("code is not null")
    got = python_rows(rows, _counts, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(NATURAL), BUCKETS), 0.05)
    np.add.at(table, (got["lang"].to_numpy(), got["bucket"].to_numpy()), got["n"].to_numpy())
    return np.log(table / table.sum(axis=1, keepdims=True))


def identify(text: str, model: np.ndarray) -> str:
    return NATURAL[int(np.argmax(model[:, grams(text)].sum(axis=1)))]


FOUND = "file_id long, nl_lang string, segments int, nl_bytes long, file_bytes long"


def natural_language(files: DataFrame, contents: DataFrame, documents: DataFrame, docstrings: DataFrame | None = None) -> DataFrame:
    """file_id, nl_lang, segments, nl_bytes and file_bytes, a row per file and language found in it.

    Files without content or with an unknown extension, and files that are no
    source code at all, give no row; nor do comments and literals of code,
    queries, paths or fewer words than running text has. ``docstrings``
    (file_id, docstring) speak for the files without content, of which no size
    is known (file_bytes is null).
    """
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(fit_languages(documents).astype(np.float32))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for pdf in batches:
            rows = []
            for file_id, language, content in zip(pdf["file_id"], pdf["language"], pdf["content"]):
                total: dict[str, list[int]] = {}
                for s in segments(content, language):
                    code = known.get(s)
                    if code is None:
                        code = known[s] = identify(s, model)
                        if len(known) > 100_000:
                            known.clear()
                    sums = total.setdefault(code, [0, 0])
                    sums[0] += 1
                    sums[1] += len(s.encode())
                size = len(content.encode())
                rows += [(file_id, code, n, b, size) for code, (n, b) in total.items()]
            yield pd.DataFrame(rows, columns=["file_id", "nl_lang", "segments", "nl_bytes", "file_bytes"]).astype(
                {"file_id": "int64", "segments": "int32", "nl_bytes": "int64", "file_bytes": "int64"})

    source = source_files(files, contents, alike=True)
    out = python_rows(source.select("file_id", "language", "content"), found, FOUND)
    if docstrings is None:
        return out

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, identify(s, shared.value), 1, len(s.encode())) for i, text in zip(pdf["file_id"], pdf["docstring"])
                    for s in _paragraphs(_lines("string", plain_text(text), ""))]
            yield pd.DataFrame(rows, columns=["file_id", "nl_lang", "segments", "nl_bytes"]).astype({"file_id": "int64", "segments": "int32", "nl_bytes": "int64"})

    without = docstrings.where("docstring is not null").select("file_id", "docstring").distinct().join(
        contents.where("content is not null").select("file_id").distinct(), "file_id", "left_anti").join(project_files(files).select("file_id"), "file_id", "left_semi")
    spoken = python_rows(without, told, "file_id long, nl_lang string, segments int, nl_bytes long").groupBy("file_id", "nl_lang").agg(
        F.sum("segments").cast("int").alias("segments"), F.sum("nl_bytes").alias("nl_bytes"))
    return out.unionByName(spoken.withColumn("file_bytes", F.lit(None).cast("long")))

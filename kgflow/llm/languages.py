"""Problem 5: languages of documents and of their segments (multilingual mixture over character n-grams)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: The languages that are told apart.
LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "ja", "pt", "ru", "th", "zh")
#: About so many documents a language, chosen by the hash of their ids, fit the n-gram models; all documents are then judged.
FIT_DOCS = 400
TRI_BITS, UNI_BITS = 16, 12
#: A language is added to a document's set only if the log-likelihood gains more than this; n-grams overlap, hence the temper.
PENALTY = 10.0
TEMPER = 0.5
#: Documents of at least LONG letters whose characters score this many standard deviations under the main language's median are in none of LANGUAGES.
LONG, FAR = 40, 8.0
#: Code of a text in none of LANGUAGES.
OTHER = "und"
PIECE = 500
SHORT = 16

#: Names and codes of languages, ISO 639-1 first.
NAMES = {
    "ar": "ar ara arabic arabe arabisch العربية",
    "bg": "bg bul bulgarian български",
    "ca": "ca cat catalan català catala valencian",
    "cs": "cs ces cze czech čeština",
    "da": "da dan danish dansk",
    "de": "de deu ger german deutsch allemand alemán aleman",
    "el": "el ell gre greek ελληνικά",
    "en": "en eng english anglais inglés ingles englisch",
    "es": "es spa spanish español espanol castellano espagnol spanisch",
    "fa": "fa fas per persian farsi فارسی",
    "fi": "fi fin finnish suomi",
    "fr": "fr fra fre french français francais französisch francés",
    "gl": "gl glg galician galego",
    "he": "he heb iw hebrew עברית",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "hu": "hu hun hungarian magyar",
    "id": "id ind in indonesian",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語",
    "ko": "ko kor korean 한국어",
    "lo": "lo lao ລາວ",
    "mr": "mr mar marathi मराठी",
    "ne": "ne nep nepali नेपाली",
    "nl": "nl nld dut dutch nederlands flemish",
    "no": "no nor nb nob nn nno norwegian norsk",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues portugiesisch",
    "ro": "ro ron rum romanian română",
    "ru": "ru rus russian русский russisch",
    "sv": "sv swe swedish svenska",
    "th": "th tha thai ไทย",
    "tr": "tr tur turkish türkçe",
    "uk": "uk ukr ukrainian українська",
    "ur": "ur urd urdu اردو",
    "vi": "vi vie vietnamese",
    "zh": "zh zho chi cmn chinese mandarin zh 中文 汉语 漢語 普通话",
}
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}


def code_of(label: str | None) -> str | None:
    """The ISO 639-1 code a label names in whatever notation, or None if it says nothing (und, unknown, xx, empty ...)."""
    if not label:
        return None
    plain = label.strip().lower()
    return _CODE.get(plain) or _CODE.get(regex.split(r"[\s_\-.@(/,;]", plain)[0])


_CUT = regex.compile(
    r"\r?\n(?:[^\S\n]*\r?\n)+[^\S\n]*|\r?\n(?=[^\S\n]*- )"  # blank line, list item
    r"|(?<=[.!?…؟।][\"'”’»)]*)\s+|(?<=[。！？．][」』”’）]*)(?![」』”’）、，。])\s*|(?<=\p{Thai})\s+|\s+(?=\p{Thai})"
)
_LETTERS = regex.compile(r"\p{L}")


def segments(text: str) -> list[tuple[int, int]]:
    """Spans of roughly a sentence each; they need not be exact, as neighbours of one language are joined later.

    After an abbreviation nothing is cut: a full stop with less than SHORT letters before it, or (in a text that uses
    upper case) with a small letter or a digit after it.
    """
    out, at = [], 0
    cased = text != text.lower()
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        if m and m.end() == m.start() == at:
            continue
        if m and end and text[end - 1] == "." and "\n" not in m[0].strip(" ") and m.end() < len(text):
            nxt = text[m.end()]
            if cased and (nxt.islower() or nxt.isdigit()) or sum(map(str.isalpha, text[at:end])) < SHORT:
                continue
        if text[at:end].strip():
            out.append((at, end))
        at = m.end() if m else end
    return out


_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> str:
    """Lower-case letters with single blanks for all else."""
    return " " + _NOT_LETTER.sub(" ", text.lower()).strip() + " "


def unaccented(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ"))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets, character buckets, where each text begins) of plain texts put one after another."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    p = np.concatenate([c, np.zeros(2, np.uint32)])
    with np.errstate(over="ignore"):
        h = (p[:-2] * np.uint32(0x9E3779B1)) ^ (p[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)) ^ (p[2:] * np.uint32(0xC2B2AE3D))
        h *= np.uint32(0x27D4EB2F)
        u = c * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - TRI_BITS)).astype(np.int64), (u >> np.uint32(32 - UNI_BITS)).astype(np.int64), starts


class Model:
    """Smoothed log-probabilities of hashed trigrams and characters, a column for each language. 2.9 MB, whatever the data.

    floor: per language, the least mean score of a character at which a document of at least LONG letters is still taken for it.
    """

    def __init__(self, tri: np.ndarray, uni: np.ndarray):
        self.floor = np.full(tri.shape[1], -np.inf)
        mean = tri.sum(1, keepdims=True) / max(1.0, tri.sum())
        self.tri = np.log((tri + 200.0 * mean + 0.02) / (tri.sum(0) + 200.0 + 0.02 * len(tri))).astype(np.float32)
        self.uni = np.log((uni + 0.5) / (uni.sum(0) + 0.5 * len(uni))).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Tempered log-likelihood of each plain text in each language."""
        if not texts:
            return np.zeros((0, self.tri.shape[1]))
        t, u, starts = grams(texts)
        return np.add.reduceat((self.tri[t] + self.uni[u]) * np.float32(0.5), starts, axis=0, dtype=np.float64) * TEMPER


def counts(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = weights.shape[1]
    tri, uni = np.zeros((1 << TRI_BITS, k)), np.zeros((1 << UNI_BITS, k))
    for at in range(0, len(texts), 2000):
        t, u, _ = grams(texts[at : at + 2000])
        w = np.repeat(weights[at : at + 2000], [len(x) for x in texts[at : at + 2000]], axis=0)
        for j in range(k):
            tri[:, j] += np.bincount(t, w[:, j], minlength=len(tri))
            uni[:, j] += np.bincount(u, w[:, j], minlength=len(uni))
    return tri, uni


def fit(texts: list[str], labels: list[str], rounds: int = 3) -> Model:
    """Models from texts with unreliable labels: first as labelled, then by expectation-maximisation over their segments."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for a, b in segments(t):
            parts.append(plain(t[a:b]))
            owner.append(i)
    own = np.array([LANGUAGES.index(x) for x in labels])[owner] if owner else np.zeros(0, int)
    extra = [unaccented(p) for p in parts]
    more = [i for i, (p, e) in enumerate(zip(parts, extra)) if p != e]
    weights = np.eye(len(LANGUAGES))[own]

    def model(w: np.ndarray) -> Model:
        return Model(*counts(parts + [extra[i] for i in more], np.concatenate([w, 0.3 * w[more]])))

    m = model(weights)
    for _ in range(rounds):
        z = m.score(parts)
        z[np.arange(len(own)), own] += 2.0  # the label counts for something
        z -= z.max(1, keepdims=True) if len(z) else 0
        weights = np.exp(z)
        weights /= weights.sum(1, keepdims=True)
        m = model(weights)
    z, best = m.score(parts), weights.argmax(1) if len(parts) else np.zeros(0, int)
    size = np.array([len(p) for p in parts])
    for j in range(len(LANGUAGES)):
        own = next((x for least in (LONG, LONG // 2) if len(x := np.flatnonzero((best == j) & (size >= least))) >= 30), ())
        if not (best == j).any():  # nothing to know it by
            m.floor[j] = np.inf
        elif len(own):
            mean = z[own, j] / size[own]
            m.floor[j] = np.median(mean) - FAR * mean.std()
    return m


def mixture(z: np.ndarray, size: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(languages, their proportions, posterior of each segment among them) of a document with segment log-likelihoods z.

    The set begins with the language of the greatest joint likelihood and takes in, one at a time, the language that raises the
    likelihood of the mixture most, as long as that exceeds the penalty. Proportions come from expectation-maximisation.
    """

    def em(chosen: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        pi = np.full(len(chosen), 1 / len(chosen))
        x = z[:, chosen]
        for _ in range(12):
            y = x + np.log(pi)
            top = y.max(1, keepdims=True)
            q = np.exp(y - top)
            q /= q.sum(1, keepdims=True)
            pi = np.maximum((q * size[:, None]).sum(0) / size.sum(), 1e-6)
            pi /= pi.sum()
        return float((top[:, 0] + np.log(np.exp(y - top).sum(1))).sum()), pi, q

    chosen = [int(z.sum(0).argmax())]
    best, pi, q = float(z[:, chosen[0]].sum()), np.ones(1), np.ones((len(z), 1))
    while len(chosen) < z.shape[1]:
        gain = np.maximum(z - z[:, chosen].max(1, keepdims=True), 0).sum(0)
        new = int(gain.argmax())
        if gain[new] <= penalty:
            break
        value, pi2, q2 = em([*chosen, new])
        if value - best <= penalty:
            break
        chosen, best, pi, q = [*chosen, new], value, pi2, q2
    return chosen, pi, q


def judge(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its stretches of one language: (start, end, language, confidence, letters), in order."""
    spans = [segments(t) for t in texts]
    parts = [plain(t[a:b]) for t, s in zip(texts, spans) for a, b in s]
    scores, out, at = model.score(parts), [], 0
    for text, s in zip(texts, spans):
        z, p = scores[at : at + len(s)], parts[at : at + len(s)]
        at += len(s)
        size = np.array([len(x.replace(" ", "")) for x in p], dtype=float)
        if not len(s) or not size.sum():
            out.append([])
            continue
        chosen, _, q = mixture(z, size)
        full = np.exp(z - z.max(1, keepdims=True))
        full /= full.sum(1, keepdims=True)
        found: list[list] = []
        for i, (a, b) in enumerate(s):
            j = int(q[i].argmax()) if size[i] else -1
            lang = LANGUAGES[chosen[j]] if j >= 0 else (found[-1][2] if found else LANGUAGES[chosen[0]])
            sure = float(full[i, chosen[j]] if len(chosen) == 1 else q[i, j]) if j >= 0 else 0.0
            mine = float(z[i, chosen[j]]) if j >= 0 else 0.0
            if found and found[-1][2] == lang:
                last = found[-1]
                last[3] = (last[3] * last[4] + sure * size[i]) / max(1.0, last[4] + size[i])
                last[1], last[4], last[5], last[6] = b, last[4] + size[i], last[5] + mine, last[6] + len(p[i])
            else:
                found.append([a, b, lang, sure, size[i], mine, len(p[i])])
        main = max(found, key=lambda f: f[4])
        strange = size.sum() >= LONG and sum(f[5] for f in found) < sum(f[6] for f in found) * model.floor[LANGUAGES.index(main[2])]
        # what is like none of the languages is one stretch, with confidence in none
        out.append([(found[0][0], found[-1][1], OTHER, 0.0, int(size.sum()))] if strange else [(a, b, lang, c, int(n)) for a, b, lang, c, n, _, _ in found])
    return out


def code_column(c: str) -> Column:
    """code_of as a Column expression."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_CODE.items()) for x in pair])
    plain = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_extract(plain, r"(?U)^([^\s_\-.@(/,;]*)", 1)))


def train(df: DataFrame, id_col: str, docs: int) -> Model:
    """Fit the models on about `docs` documents a language, by the codes their labels name: one scan counts the codes, one takes the sample."""
    coded = df.withColumn("_code", code_column("lang")).filter(F.col("_code").isin(*LANGUAGES))
    total = {r["_code"]: r["count"] for r in coded.groupBy("_code").count().collect()}
    if not total:
        return Model(np.zeros((1 << TRI_BITS, len(LANGUAGES))), np.zeros((1 << UNI_BITS, len(LANGUAGES))))
    share = F.create_map(*[F.lit(x) for c, n in sorted(total.items()) for x in (c, int(1_000_000 * min(1.0, docs / n)) + 1)])
    drawn = coded.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.element_at(share, F.col("_code")))
    got = drawn.select("text", F.col("_code").alias("code"), F.col(id_col).alias("_id")).limit(4 * docs * len(LANGUAGES))  # a repeated id can't fill the driver
    got = sorted(got.collect(), key=lambda r: (r.code, r._id, r.text))
    return fit([r.text for r in got], [r.code for r in got])


def _stretches(df: DataFrame, id_col: str, fit_docs: int) -> DataFrame:
    """language_stretches with label, the code that the row's lang names."""
    prose = df.select(id_col, "text", "lang").filter(r"text RLIKE '\\p{L}'")
    model = train(prose, id_col, fit_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                pdf = whole.iloc[at : at + PIECE]
                rows = [(i, l, n, *x) for i, l, xs in zip(pdf[id_col], pdf["label"], judge(list(pdf["text"]), model)) for n, x in enumerate(xs)]
                yield pd.DataFrame(rows, columns=[id_col, "label", "stretch_no", "start_at", "end_at", "lang", "confidence", "letters"])

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, label string, stretch_no int, start_at long, end_at long, lang string, confidence double, letters long"
    return spread(prose.select(id_col, "text", code_column("lang").alias("label"))).mapInPandas(run, schema)


def language_stretches(df: DataFrame, id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> DataFrame:
    """id_col, stretch_no, start_at, end_at, lang, confidence, letters for every stretch of one language in `text`.

    Per document, expectation-maximisation estimates language proportions from the n-gram likelihoods of its segments; the
    set of languages is grown while the penalised likelihood rises. df holds id_col, text and lang (the unreliable
    label; used only to fit). NULL, empty and letterless texts have no row; a repeated row is judged each time; texts are
    processed whole. Confidence is the mean posterior of the stretch's segments, weighted by their letters. A
    document that is unlike all LANGUAGES is one stretch of OTHER with confidence 0.
    """
    return _stretches(df, id_col, fit_docs).drop("label")


def document_languages(df: DataFrame, id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> DataFrame:
    """id_col, label (what lang says, as a code), languages (main one first), confidence, is_case for every document with letters.

    is_case: the label is missing or says nothing, names another language than the only one found, or several were found.
    Rows of one id are one document, whose label is the least of theirs. A language that is none of LANGUAGES is OTHER.
    """
    doc = _stretches(df, id_col, fit_docs).groupBy(id_col, "lang").agg(F.min("label").alias("label"), F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("c"))
    doc = doc.groupBy(id_col).agg(
        F.min("label").alias("label"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))), lambda x: x["lang"]).alias("languages"),
        (F.sum("c") / F.sum("n")).alias("confidence"),
    )
    only_other = (F.size("languages") == 1) & (F.element_at("languages", 1) == OTHER)
    case = F.col("label").isNull() | (F.size("languages") > 1) | ((F.col("label") != F.element_at("languages", 1)) & ~(only_other & ~F.col("label").isin(*LANGUAGES)))
    return doc.select(id_col, "label", "languages", "confidence", case.alias("is_case"))

"""Text decoded with the wrong character encoding, found and restored.

A multinomial classifier over hashed byte bigrams predicts for each run of non-ASCII characters the chain of encodings
that garbled it, or that it is clean. It is trained here: clean texts of a bounded seeded sample, and constant phrases of
the languages concerned, are garbled by every chain. Runs that the classifier doesn't hold for clean are
suspicious; the chain of a text is the one most likely for all its suspicious runs together. Only the few likeliest chains are
inverted: a run must decode strictly, into plausible characters, and the classifier must find the outcome cleaner than what it
was. Runs that don't belong to the text's chain (text may be garbled in part, or in two ways) take their own likeliest one.

A text is affected if a run is restored, or if it holds replacement characters; the latter are lost for good.

Defined results: null, empty and pure ASCII texts aren't affected; a text that is both garbled and has lost characters
counts as lost; texts are read whole; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.tables import hash_sample

# Encodings that UTF-8 text gets read with, once or twice.
CHAINS: list[tuple[str, ...]] = [(c,) for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251", "cp850", "iso8859-15", "cp1254", "cp866", "koi8-r", "iso8859-2", "mac_cyrillic")] + [("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman")]
# Phrases that every model is trained with, so that a sample without accents still teaches it.
PHRASES = [
    "Wir grüßen aus Köln – bis später! Für Größe, Übung und Äpfel: „gut“.", "Les tâches évoluent : où ça ? L’équipe à Orléans, façon cœur, naïve. Élan Ça",
    "¿Señor, mañana? ¡Sí! El año próximo, según la región; información útil. Ángel Ñandú", "Você não está à procura de ações, informações e opiniões? Ângela É Ã Õ FORMAÇÃO",
    "募集中 エンジニア 東京 です 软件工程师 한국어 개발자", "مطلوب مهندس برمجيات", "דרוש מהנדס תוכנה", "😀🚀✨ ⌚ ✔️ 👩‍💻 ⭐ 🎉 👉 ✅",
    "Мы ищем специалиста. Опыт работы не менее трёх лет, гибкий график, дорога до офиса. Вы будете отвечать за проекты; Щ Э Ю Я ы ъ ё", "It’s “fine” – 5 € or £3, 20 °C ± 2 • №7… café résumé Kraków Málaga Zürich Zoë",
]
RUN = re.compile(r"[^\x00-\x7f]+")
BUCKETS = 4096
LOST = "�"


def wrongly(data: bytes, codec: str) -> str:
    """Bytes read with a codec; bytes it doesn't define become the control characters of the same number."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_BACK: dict[str, dict[str, int]] = {}


def backwards(text: str, codec: str) -> bytes | None:
    """The bytes that the codec read as this text, None if there are none."""
    if codec not in _BACK:
        _BACK[codec] = {wrongly(bytes([b]), codec): b for b in range(255, -1, -1)}
    table = _BACK[codec]
    try:
        return bytes(table[c] for c in text)
    except KeyError:
        return None


def garble(text: str, chain: tuple[str, ...]) -> str:
    for codec in chain:
        text = wrongly(text.encode("utf-8"), codec)
    return text


def wide(o: int) -> bool:
    """Whether a code point is of a script beyond Latin, Greek and Cyrillic: Armenian to Georgian, and East Asian ones."""
    return 0x530 <= o < 0x1200 or 0x2E80 <= o < 0xA4D0 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0xFB1D <= o < 0xFE00 or 0xFE30 <= o < 0xFFF0 or 0x20000 <= o < 0x32000


def plausible(text: str, least_wide: int = 2) -> bool:
    """Whether every character is assigned and a letter or mark that texts have.

    Clean text such as "é", a no-break space and "»" happens to be one East Asian character in some encoding, so of the wide
    scripts there must be least_wide characters. Marks must follow a letter of such a script or a symbol.
    """
    many = 0
    for i, c in enumerate(text):
        o = ord(c)
        if o < 128:
            continue
        kind = unicodedata.category(c)
        if 0x80 <= o < 0xA0 or kind in ("Co", "Cn", "Cs", "Me"):
            return False
        if kind in ("Mn", "Mc"):
            if i == 0 or not (wide(ord(text[i - 1])) or o in (0xFE0E, 0xFE0F)):
                return False
            continue
        if wide(o):
            many += 1
        elif not (o < 0x250 or 0x370 <= o < 0x530 or 0x2000 <= o < 0x2070 or 0x20A0 <= o < 0x2800 or 0x2900 <= o < 0x2C00 or 0x1F000 <= o < 0x1FB00):
            return False
    return many == 0 or many >= least_wide


def ungarble(run: str, chain: tuple[str, ...], least_wide: int = 2) -> str | None:
    """A run with its chain undone; None if a step doesn't decode strictly or the outcome isn't plausible."""
    text = run
    for codec in reversed(chain):
        data = backwards(text, codec)
        if data is None:
            return None
        try:
            new = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if new == text:
            return None
        text = new
    return text if plausible(text, least_wide) else None


def bigrams(run: str) -> np.ndarray:
    """Hashed pairs of the UTF-8 bytes of a run of non-ASCII characters, with a space on either side."""
    data = np.frombuffer(f" {run} ".encode(), dtype=np.uint8).astype(np.int64)
    return ((data[:-1] * 257 + data[1:]) * 2654435761 % (1 << 32)) >> 20


class ChainModel:
    """Multinomial naive Bayes over hashed byte bigrams; class 0 is clean text, class i the chain CHAINS[i - 1].

    doubt: a run is suspicious unless clean text is likelier than the likeliest chain by more than this many log units; what is
    suspected without reason fails the strict decoding. tries: so many chains are inverted for a run, the likeliest first.
    """

    def __init__(self, clean: list[str], doubt: float = 4.0, tries: int = 3) -> None:
        self.doubt, self.tries = doubt, tries
        counts = np.full((len(CHAINS) + 1, BUCKETS), 0.1)
        for run, n in Counter(r for text in [*PHRASES * 3, *clean] for r in RUN.findall(text)).items():
            for i, version in enumerate([run, *(garble(run, c) for c in CHAINS)]):
                np.add.at(counts[i], bigrams(version), n)
        self.log = np.log(counts / counts.sum(1, keepdims=True))
        self.seen: dict[str, np.ndarray] = {}

    def odds(self, run: str) -> np.ndarray:
        """Log likelihood of a run under every class."""
        got = self.seen.get(run)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[run] = self.log[:, bigrams(run)].sum(1)
        return got

    def ranked(self, odds: np.ndarray, longest: int) -> list[int]:
        """The likeliest chains (numbers in CHAINS), best first; a chain makes at least two characters of one with each step."""
        fits = [i for i, c in enumerate(CHAINS) if 2 ** len(c) <= longest]
        return sorted(fits, key=lambda i: -odds[i + 1])[: self.tries]

    def undo(self, run: str, chains: list[int], least_wide: int = 2) -> str | None:
        """A run with the first of some chains undone that leaves it cleaner than it was; None if none does."""
        was = self.odds(run)
        for i in chains:
            new = ungarble(run, CHAINS[i], least_wide)
            if new is None:
                continue
            now = self.odds(new) if not new.isascii() else None
            # what still looks garbled was garbled by a longer chain; what looks less clean than before was clean
            if now is None or now[0] - now[1:].max() > was[0] - was[1:].max():
                return new
        return None

    def restore(self, text: str) -> tuple[str, bool] | None:
        """(restored text, all of it restored); None if the text isn't affected."""
        if text.isascii():
            return None
        if LOST in text:
            return text, False
        runs = dict.fromkeys(RUN.findall(text))
        suspicious = [r for r in runs if (o := self.odds(r))[0] - o[1:].max() <= self.doubt]
        if not suspicious:
            return None
        chains = self.ranked(sum(self.odds(r) for r in suspicious), max(map(len, suspicious)))
        fixed = {}
        for r in suspicious:
            new = self.undo(r, chains)
            if new is None:
                new = self.undo(r, self.ranked(self.odds(r), len(r)))
            if new is not None:
                fixed[r] = new
        if not fixed:
            return None
        if any(wide(ord(c)) for t in fixed.values() for c in t):  # then single characters of such a script are no chance
            fixed |= {r: t for r in runs if r not in fixed and (t := self.undo(r, chains, 1)) is not None}
        return RUN.sub(lambda m: fixed.get(m.group(), m.group()), text), True


def is_clean(text: str) -> bool:
    return LOST not in text and all(ungarble(r, c) is None for r in set(RUN.findall(text)) for c in CHAINS)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 600) -> ChainModel:
    """A model from a seeded sample of at most sample_docs texts with non-ASCII characters; those without garbled runs are used."""
    some = docs.where(F.col(text).rlike(r"[^\x00-\x7f]"))
    return ChainModel([t for (t,) in hash_sample(some, [text], key, sample_docs, some.count()) if is_clean(t)])


def restored(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 600, model: ChainModel | None = None) -> DataFrame:
    """(key, restored_text, restored_chars) of affected rows; the text is null and its length 0 where characters are lost.

    Pure ASCII rows never leave the JVM; nothing is shuffled.
    """
    model = model or train(docs, text, key, sample_docs)
    kind = dict(docs.dtypes)[key]

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts, sizes = [], [], []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if (got := model.restore(t)) is not None:
                    keys.append(k)
                    texts.append(got[0] if got[1] else None)
                    sizes.append(len(got[0]) if got[1] else 0)
            yield pd.DataFrame({key: pd.Series(keys, dtype=object), "restored_text": pd.Series(texts, dtype=object), "restored_chars": pd.Series(sizes, dtype="int64")})

    part = docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return part.mapInPandas(repair, f"{key} {kind}, restored_text string, restored_chars bigint")

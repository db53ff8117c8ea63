"""Token ids of whole texts with a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

from array import array

#: Words whose ids a Python worker keeps; later words are encoded anew each time.
CACHE_WORDS = 400_000


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ENDS = PUNCTUATION.encode()
#: The character that byte-level vocabularies write for each byte: visible Latin-1 ones as they are, others from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def plain_words(tokenizer) -> bool:
    """Whether a run of Latin letters and the ASCII punctuation after it are lower-cased and then given to the model
    apart, as bytes: so the library's model can be asked at once, without its normaliser and splitter."""
    probe = ["hello,", "\u00c9t\u00e9!?", "stra\u00dfe"]
    try:
        for w in probe:
            low = w.lower()
            stem = low.rstrip(PUNCTUATION)
            ids = [t.id for t in tokenizer.model.tokenize("".join(map(BYTE_CHARS.__getitem__, stem.encode())))]
            if stem != low:
                ids += tokenizer.encode(low[len(stem) :], add_special_tokens=False).ids
            if ids != tokenizer.encode(w, add_special_tokens=False).ids:
                return False
    except Exception:  # noqa: BLE001  another kind of model
        return False
    return True


class WordEncoder(dict):
    """Ids of texts as packed little-endian bytes. The tokenizer drops white space and works inside words alone, so the
    ids of a text are those of its words (split at ASCII white space) in order; each word is encoded by the library."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

        self.model, self.plain = self.tokenizer.model, plain_words(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        return self.ids(word)

    def ids(self, word: bytes, keep: bool = True) -> bytes:
        """Ids of a word that isn't in the cache; keep: whether they go there, if there is room."""
        small = word.lower()
        bare = small.rstrip(ENDS)
        if self.plain and bare.isalpha():  # ASCII letters, which stand for their own bytes
            ids = self.get(bare) or self._stem(bare, bare.decode(), keep)
            if len(bare) < len(small):
                ids += self[small[len(bare) :]]
            elif bare == word:
                return ids
        else:
            low = word.decode().lower()
            stem = low.rstrip(PUNCTUATION)
            if not (self.plain and stem.isalpha() and (stem.isascii() or max(stem) < "\u0250")):
                ids = array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            elif (bare := stem.encode()) != word:  # the model sees a stem once, whatever its case and the punctuation after it
                ids = self.get(bare) or self._stem(bare, stem, keep)
                if len(stem) < len(low):
                    ids += self[low[len(stem) :].encode()]
            else:
                return self._stem(bare, stem, keep)
        if keep and len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def _stem(self, bare: bytes, stem: str, keep: bool = True) -> bytes:
        """Ids of a lower-case run of letters; ASCII ones stand for their own bytes."""
        seen = stem if len(bare) == len(stem) else "".join(map(BYTE_CHARS.__getitem__, bare))
        ids = array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()
        if keep and len(self) < CACHE_WORDS:
            self[bare] = ids
        return ids

    def pack(self, text: bytes, end: int) -> bytes:
        """Ids of text and the end id."""
        return b"".join(map(self.__getitem__, text.split())) + end.to_bytes(self.width, "little")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def binary_texts(column):
    """An Arrow string column's rows as bytes, nulls as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]

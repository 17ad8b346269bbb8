"""Pre-tokens and pieces of the lower-casing word-end BPE vocabulary, by block.

White space never lies inside a pre-token, so a text's pre-tokens are those of its white-space words in order. A
block's distinct words are therefore split once, whatever their frequency. Texts whose characters lie outside
``PLAIN`` (other scripts, odd spaces, controls, the special strings) go through the library's own normaliser and
splitter instead, whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: Characters for which lower-casing, NFC, white space and the letter and number classes are the same in every library.
PLAIN = "\\x{09}-\\x{0d}\\x{20}-\\x{7e}\\x{a1}-\\x{12f}\\x{131}-\\x{239}\\x{23b}-\\x{23d}\\x{23f}-\\x{2ff}\\x{2010}-\\x{2027}\\x{20ac}"
ODD = f"[^{PLAIN}]|<\\|"


def _class(kind: str) -> str:
    return "".join(chr(c) for c in range(0x21, 0x300) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CHARS = _byte_chars()
_BYTES = {c: b for b, c in _CHARS.items()}
_TOKENIZER = {}


def tokenizer(name: str = VOCABULARY):
    """The library's tokenizer, once for each worker; every executor has the public vocabulary files installed."""
    if name not in _TOKENIZER:
        import public_tokenizers
        from tokenizers import Tokenizer

        _TOKENIZER[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _TOKENIZER[name]


_OWN = re.compile("[!-~]*")


def mapped(pre: str) -> str:
    return pre if _OWN.fullmatch(pre) else "".join(map(_CHARS.__getitem__, pre.encode()))


def unmapped(chars: str) -> str:
    return bytes(map(_BYTES.__getitem__, chars)).decode()


def odd_pretokens(text: str, tok) -> list[str]:
    """A text's pre-tokens by the library's own steps; a special string stands for itself."""
    out: list[str] = []
    for part in re.split("(" + "|".join(map(re.escape, SPECIALS)) + ")", text):
        if part in SPECIALS:
            out.append(part)
        elif part:
            out.extend(unmapped(p) for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part)))
    return out


def piece_ids(pre: str, tok) -> list[int]:
    if pre in SPECIALS:
        return [tok.token_to_id(pre)]
    return [t.id for t in tok.model.tokenize(mapped(pre))]


class Coded:
    """A block of texts as numbers: word ``codes`` into ``words``, and each text's end among them; -1 marks odd texts."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        self.odd = np.asarray(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False), bool)
        low = pc.if_else(pa.array(self.odd), "", pc.utf8_lower(texts))
        split = pc.ascii_split_whitespace(low)
        ends = split.offsets.to_numpy()
        flat = split.flatten().dictionary_encode()
        codes, self.words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        per_text = np.diff(ends)
        if "" in self.words:  # from white space at either end of a text
            keep = codes != self.words.index("")
            owner = np.repeat(np.arange(len(per_text)), per_text)[keep]
            codes, per_text = codes[keep], np.bincount(owner, minlength=len(per_text))
        self.codes, self.per_text = codes, per_text


def ragged_take(lists_start: np.ndarray, lists_len: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions, in a flat array, of the concatenated lists that ``codes`` names."""
    n = lists_len[codes]
    total = int(n.sum())
    shift = np.repeat(lists_start[codes] - (np.cumsum(n) - n), n)
    return np.arange(total) + shift

"""Public tokenizers on executors: files are found on each machine, loaded once per worker, and never trained.

The library encodes any text exactly but slowly. Latin-1 texts, for which all libraries' Unicode tables agree, take a
faster way with the same result: the vocabulary's rank file for ids, and per-word counts that are remembered. Every
other text goes to the library whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Words whose counts a worker remembers; it starts anew beyond that.
REMEMBER = 400_000


def path(name: str) -> str:
    """Where this machine has the file: the name itself if it is a path, else as the public package says."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.no_padding()
    t.no_truncation()
    return t


@cache
def version(name: str) -> str:
    """A digest of the file: another vocabulary is another version."""
    with open(path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def id_encoder(name: str) -> Callable[[str], np.ndarray]:
    """ids of a text by tokenizers, add_special_tokens=False. If NAME.tiktoken is beside NAME.json, it does Latin-1."""
    lib = library(name)
    slow = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32)
    ranks_at = re.sub(r"\.json$", ".tiktoken", path(name))
    model = json.loads(lib.to_str())
    pre = model["pre_tokenizer"] or {}
    if not os.path.exists(ranks_at) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model["normalizer"]:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_at, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    fast = tiktoken.Encoding(os.path.basename(ranks_at), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(t: str) -> np.ndarray:
        if _latin(t):
            try:
                return fast.encode_to_numpy(t, allowed_special="all")
            except ValueError:  # its pattern gives up on white space of about a million characters in a row
                pass
        return slow(t)

    return encode


@cache
def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, without added special tokens, by the library."""
    lib = library(name)
    model = json.loads(lib.to_str())
    special = [t["content"] for t in model["added_tokens"]]
    split = _word_pattern(model)
    if split is None:
        return lambda texts: [len(e) for t in texts for e in lib.encode_batch_fast([t], add_special_tokens=False)]
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        words: list[list[str] | int] = []
        fresh: set[str] = set()
        if len(known) > REMEMBER:
            known.clear()
        for t in texts:
            if any(s in t for s in special) or not _latin(t):
                words.append(len(lib.encode(t, add_special_tokens=False)))
            else:
                words.append(w := split(lib.normalizer.normalize_str(t)))
                fresh.update(x for x in w if x not in known)
        todo = list(fresh)
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            known.update(zip(part, map(len, lib.encode_batch_fast(part, add_special_tokens=False))))
        get = known.__getitem__
        return [w if isinstance(w, int) else sum(map(get, w)) for w in words]

    return count


@cache
def keeps_white_space(name: str) -> bool:
    """Whether the length or kind of ASCII white space between words can change the tokens, as far as its file says.

    It cannot where the normaliser makes one space of any run, and the pre-tokenizer leaves spaces out.
    """
    lib = library(name)
    split = _word_pattern(json.loads(lib.to_str()))
    probe = "a \t\n\x0b\f\r b  c"
    return split is None or lib.normalizer.normalize_str(probe) != "a b c" or split("a b c") != ["a", "b", "c"]


def _word_pattern(model: dict) -> Callable[[str], list[str]] | None:
    """How the pre-tokenizer cuts a normalised text into words, each of which is then encoded by itself; None if unknown."""
    import regex

    parts = (model["pre_tokenizer"] or {}).get("pretokenizers") or []
    if len(parts) != 2 or [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
        return None
    p = parts[0]
    if "Regex" not in p["pattern"] or p["behavior"] != "Removed" or not p["invert"] or model["post_processor"] or not model["normalizer"]:
        return None
    return regex.compile(p["pattern"]["Regex"]).findall

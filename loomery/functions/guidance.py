"""Classes of guidance models by hash and by name, as one expression out of a table of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hashes of known models; words that tell a family; in order, the kinds of each family with their words (a
# tuple of words that must all be there).
SIGNATURES = {
    ("ipadapter", "plus"): ["932b88cf", "d3e09866", "1ea82f05"],
    ("ipadapter", "faceid"): ["ac2342c3", "1894d07b"],
    ("ipadapter", "full-face"): ["7f21a4b5", "de70a1a8"],
    ("ipadapter", "standard"): ["893d2892", "5833c8f8"],
    ("controlnet", "canny"): ["cc498871", "f2549278", "9329158c"],
    ("controlnet", "depth"): ["f26f6342", "97a6e70d", "1648a74e"],
    ("controlnet", "pose"): ["88e367c3", "75ca82ea"],
    ("controlnet", "openpose"): ["466e0767"],
    ("controlnet", "scribble"): ["043743ec", "64f3310d"],
    ("controlnet", "lineart"): ["25ea4b20", "3535966a"],
    ("controlnet", "normal"): ["79e345cb", "3705ee1a"],
    ("controlnet", "tile"): ["9cda02fd", "95333f2a"],
    ("controlnet", "inpaint"): ["a89f92e4", "77977a45"],
}
IP_NAMES = ["ip-adapter", "ip_adapter", "ipadapter", "ip adapter", "ipad", "ip_"]
CONTROL_NAMES = ["controlnet", "control_", "cnet"]
T2I_NAMES = [("t2i", "adapter"), "t2iadapter"]
CONTROL_WORDS = ["canny", "depth", "midas", "leres", "zoe", "pose", "scribble", "lineart", "softedge", "soft_edge", "soft-edge", "mlsd", "tile", "resample", "inpaint", "shuffle", "recolor", "hed", "bae", "seg", "ade20k", "sketch"]
IP_WORDS = ["faceid", "portrait", "insightface", "reference"]
IP_LIKELY = ["face", "plus", "full", "precise"]
IP_KINDS = [
    ("faceid-plus", [("faceid", "plus")]),
    ("faceid", ["faceid", "insightface"]),
    ("portrait", ["portrait"]),
    ("plus-face", [("face", "plus"), ("full", "plus")]),
    ("full-face", ["face", "full"]),
    ("plus", ["plus", "vit-h", "vit_h", "precise", "reference"]),
    ("light", ["light"]),
    ("composition", ["composition"]),
    ("style", ["style"]),
    ("standard", [""]),
]
CONTROL_KINDS = [
    ("canny", ["canny"]),
    ("depth", ["depth", "midas", "leres", "zoe"]),
    ("pose", ["pose"]),
    ("scribble", ["scribble", "hed", "softedge", "soft_edge", "soft-edge", "sketch"]),
    ("lineart", ["lineart"]),
    ("normal", ["normal", "bae"]),
    ("inpaint", ["inpaint"]),
    ("tile", ["tile", "resample"]),
    ("mlsd", ["mlsd"]),
    ("segmentation", ["seg", "ade20k"]),
    ("ip2p", ["ip2p", "instruct"]),
    ("shuffle", ["shuffle"]),
    ("recolor", ["recolor"]),
    ("canny", ["precise"]),
    ("other", [""]),
]
EXTENSIONS = [".safetensors", ".ckpt", ".pth", ".bin", ".pt", ".gguf"]


def plain_name(name: Column) -> Column:
    """The file's name without folders, what follows a bracket, and one extension; in small letters, with _ for space and -."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    low = F.trim(F.lower(F.element_at(F.split(base, r"\("), 1)))
    bare = F.regexp_replace(low, rf"({'|'.join(e.replace('.', chr(92) + '.') for e in EXTENSIONS)})$", "")
    return F.translate(bare, " -", "__")


def _has(name: Column, words: list) -> Column:
    each = [reduce(lambda a, b: a & b, [F.contains(name, F.lit(w)) for w in ((x,) if isinstance(x, str) else x)]) for x in words]
    return reduce(lambda a, b: a | b, each)


def rules(name: Column, signature: Column) -> list[tuple[Column, str, str]]:
    """(condition, category, subtype) in order; the first one that holds counts. name: as plain_name gives it."""
    ip, control, t2i = _has(name, IP_NAMES), _has(name, CONTROL_NAMES), _has(name, T2I_NAMES)
    kind = _has(name, CONTROL_WORDS)
    adapter = ip | (~t2i & ~kind & (_has(name, IP_WORDS) | (_has(name, IP_LIKELY) & ~control)))
    out = [(signature.isin(hashes), *what) for what, hashes in SIGNATURES.items()]
    out += [(adapter & _has(name, words), "ipadapter", subtype) for subtype, words in IP_KINDS]
    for family, here in (("t2iadapter", t2i), ("controlnet", control | kind)):
        out += [(here & _has(name, words), family, subtype) for subtype, words in CONTROL_KINDS]
    return out


def classify(name: Column, signature: Column) -> Column:
    """struct(category, subtype, rule) of a model, null if no rule holds; rule is the number of the one that did, from 1."""

    def first(plain: Column) -> Column:
        found = None
        for i, (condition, category, subtype) in enumerate(rules(plain, F.coalesce(signature, F.lit(""))), 1):
            value = F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"), F.lit(i).alias("rule"))
            found = F.when(condition, value) if found is None else found.when(condition, value)
        return found

    # a lambda's variable, so that the name is cleaned once and not for every rule
    return F.transform(F.array(plain_name(F.coalesce(name, F.lit("")))), first)[0]

"""String expressions: names, match keys, paths, samplers, similarity. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of model files, placeholder prompts, path marks of generation types,
# folder names of model files, sampler display names, stop words of keyword counts.
ASSET_EXTENSION = r"(?i)\.(safetensors|ckpt|pt|bin|pth)$"
ASSET_SEPARATORS = r"[\s_.,-]+"
LABEL_SEPARATOR = r"\s+-\s+|,\s*"
PLACEHOLDERS = ["", "undefined", "null", "none", "unknown", "negative prompt:"]
GENERATION_PATHS = {
    "txt2img": ["/txt2img-images", "/outputs/txt2img", "/txt2img/", "/text/"],
    "img2img": ["/img2img-images", "/outputs/img2img", "/img2img/", "/image/"],
    "extras": ["/extras-images", "/outputs/extras", "/extras/", "/save", "/saved"],
    "grid": ["-grids", "/grids/"],
}
MODEL_FOLDERS = [
    ("loras", ["lora", "loras"]),
    (None, ["vae", "vae_approx", "clip", "clip_vision", "text_encoder", "text_encoders", "upscale_model", "upscale_models", "upscaler", "upscalers", "ultralytics", "detector", "detectors", "facedetection", "face_detection", "bbox", "segm", "sam", "sams", "caption", "captions", "caption_models", "joy_caption", "wd14_tagger", "insightface", "facerestore", "face_restore", "florence2", "florence-2", "florence_2", "gfpgan", "ldsr", "llm", "omnisr", "pulid", "realesrgan", "real-esrgan", "real_esrgan", "seedvr2", "swinir", "t2iadapter"]),
    ("embeddings", ["embedding", "embeddings", "textual_inversion"]),
    ("hypernetworks", ["hypernetwork", "hypernetworks"]),
    ("ip_adapters", ["ipadapter", "ip-adapter", "ip_adapter", "ipadapters"]),
    ("control_nets", ["controlnet", "control_net", "control-nets", "controlnets", "control_nets", "t2i_adapter", "t2i-adapter"]),
    ("checkpoint", ["checkpoint", "checkpoints", "diffusion_model", "diffusion_models", "unet", "unets"]),
]
#: Kinds whose marks count anywhere in the path, file name included.
ANYWHERE = ["ip_adapters"]
SAMPLER_NAMES = {"plms": "PLMS", "unipc": "UniPC", "ddim": "DDIM", "lms": "LMS"}
STOP_WORDS = (
    "a an the and or but for nor so yet of in on at with by from to into about through under this that these those which who whom whose "
    "is are was were been being have has had do does did will would shall should can could may might must very too also just more most some any "
    "each few only own same than then now there here style view highly detailed render 4k 8k resolution quality masterpiece best score rating "
    "source image picture v10 v20 v30 says often"
).split()


def basename(path: Column) -> Column:
    parts = F.split(F.trim(path), r"[\\/]")
    last = F.element_at(parts, -1)
    return F.when(last != "", last).otherwise(F.trim(path))


def clean_name(name: Column) -> Column:
    """A resource name without folder and model-file extension (one extension, anchored at the end)."""
    return F.trim(F.regexp_replace(basename(name), ASSET_EXTENSION, ""))


def match_key(name: Column) -> Column:
    """The key under which spellings of a name meet; null and blank give ''."""
    return F.coalesce(F.regexp_replace(F.lower(clean_name(name)), ASSET_SEPARATORS, ""), F.lit(""))


def match_key_candidates(name: Column) -> Column:
    """The match key, then those of what follows each ' - ' or ', ', without repeats."""
    whole = clean_name(name)
    parts = F.split(whole, LABEL_SEPARATOR)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))
    keys = F.transform(F.concat(F.array(whole), tails), lambda x: F.regexp_replace(F.lower(x), ASSET_SEPARATORS, ""))
    return F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(keys, lambda k: k != "")))


def canonical_reference(name: Column) -> Column:
    """A reference cut at ' (', or else at ':', and trimmed."""
    weight, colon = F.instr(name, " ("), F.instr(name, ":")
    return F.trim(F.when(weight > 0, F.substring(name, F.lit(1), weight - 1)).when(colon > 0, F.substring(name, F.lit(1), colon - 1)).otherwise(name))


def reference_weight(name: Column) -> Column:
    """The weight in 'name (0.80)' or 'name:0.8', null where there is none."""
    return F.try_to_number(F.regexp_extract(name, r"(?: \(|:)(-?\d+(?:\.\d+)?)\)?$", 1), F.lit("S999D999")).cast("double")


def format_reference(name: Column, weight: Column) -> Column:
    """'name (w.ww)'; the weight is left out when it is 1 or null."""
    return F.when(weight.isNull() | (weight == 1), name).otherwise(F.concat(name, F.lit(" ("), F.format_number(weight, 2), F.lit(")")))


def normalize_sampler(name: Column) -> Column:
    """Lower case, '_' and '-' as spaces: the form in which samplers are compared."""
    return F.trim(F.regexp_replace(F.lower(name), "[_-]", " "))


def display_sampler(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SAMPLER_NAMES.items() for x in pair])
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "Unknown").otherwise(F.coalesce(known[F.lower(F.trim(name))], F.initcap(F.regexp_replace(name, "[_-]", " "))))


def normalize_path(path: Column) -> Column:
    """Forward slashes, without the verbatim prefix, doubled or trailing slashes; a UNC root stays."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^//\?/(UNC/)?", "")
    root = F.when(plain.startswith("//"), "/").otherwise("")
    return F.concat(root, F.regexp_replace(F.regexp_replace(plain, "/{2,}", "/"), "(?<=.)/$", ""))


def path_within(path: Column, folder: Column) -> Column:
    a, b = F.lower(normalize_path(path)), F.lower(normalize_path(folder))
    return (a == b) | a.startswith(F.concat(b, F.lit("/")))


def generation_type(path: Column) -> Column:
    low = F.regexp_replace(F.lower(path), r"\\", "/")
    out = None
    for kind, marks in GENERATION_PATHS.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(low, F.lit(mark))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def model_file_type(path: Column) -> Column:
    """Kind of a model file by its folders, first rule wins; unsupported folders give null."""
    low = F.lower(normalize_path(path))
    parts = F.split(low, "/")
    out = None
    for kind, names in MODEL_FOLDERS:
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, names)))
        for name in names if kind in ANYWHERE else ():
            hit = hit | F.contains(low, F.lit(name))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def is_placeholder_prompt(prompt: Column) -> Column:
    bare = F.regexp_replace(F.trim(prompt), "(?i)^positive prompt:", "")
    return F.lower(F.regexp_replace(bare, r"^[\s,;]+|[\s,;]+$", "")).isin(PLACEHOLDERS)


def similarity(a: Column, b: Column, edits: Column | None = None) -> Column:
    """1 - edit distance (edits, if it is known) / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - (F.levenshtein(a, b) if edits is None else edits) / longer)


def to_milliseconds(stamp: Column) -> Column:
    """Epoch values below ten thousand million are seconds."""
    return F.when(stamp < 10_000_000_000, stamp * 1000).otherwise(stamp)


def format_megabytes(size: Column) -> Column:
    return F.concat(F.format_number(size / 1048576.0, 2), F.lit(" MB"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def privacy_hidden(masked: Column, prompt: Column, keywords: list[str]) -> Column:
    """An explicit mask wins; else whether the prompt holds any keyword (at most a few hundred)."""
    hit = F.lit(False)
    for word in keywords:
        if word.strip():
            hit = hit | F.contains(F.lower(prompt), F.lit(word.strip().lower()))
    return F.coalesce(masked, hit, F.lit(False))


def json_integer(json: Column, path: str) -> Column:
    """An integer that the JSON holds as a number; strings, booleans, missing and malformed give null."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "LONG"), F.try_variant_get(F.try_parse_json(json), path, "long"))


def visible(deleted: Column, intermediate: Column, grid: Column, asset: Column, hidden: Column, *, show_intermediates: bool = False, show_grids: bool = False, show_assets: bool = False, hide_private: bool = False) -> Column:
    """The default scope; unknown categories stay visible."""
    keep = ~F.coalesce(deleted, F.lit(False))
    for flag, shown in ((intermediate, show_intermediates), (grid, show_grids), (asset, show_assets)):
        if not shown:
            keep = keep & ~F.coalesce(flag, F.lit(False))
    return keep & ~F.coalesce(hidden, F.lit(False)) if hide_private else keep


def json_set(document: Column, changes: dict[str, Column]) -> Column:
    """document (a JSON object as text) with top-level keys set to text values; null or malformed documents start empty."""
    held = F.coalesce(F.from_json(F.when(F.try_parse_json(document).isNotNull(), document), "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_from_arrays(F.array(*map(F.lit, changes)), F.array(*[c.cast("string") for c in changes.values()]))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*changes)), new))


def json_remove(document: Column, *keys: str) -> Column:
    """document without some top-level keys; malformed documents give null."""
    held = F.from_json(F.when(F.try_parse_json(document).isNotNull(), document), "map<string,string>")
    return F.to_json(F.map_filter(held, lambda k, _: ~k.isin(*keys)))

"""Generation metadata out of text blocks, catalog JSON, prompts, graphs and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text

# Parameter names that begin the block, keyword groups of video modes in their order.
BLOCK_STARTS = ("Model: ", "Seed: ", "Steps: ")
VIDEO_MODES = [
    ("audio_lip_sync", ["lip", "audio", "ia2v", "audio2video"]),
    ("guided_video", ["canny", "depth", "controlnet", "guided"]),
    ("video_editing", ["bernini", "video edit", "videoedit", "editing"]),
    ("first_last_frame", ["first last", "first-last", "firstlastframe", "flf2v", "start frame", "end frame"]),
    ("image_to_video", ["i2v", "image to video", "image2video", "imagetovideo", "loadimage"]),
    ("text_to_video", ["t2v", "text to video", "text2video", "texttovideo"]),
]

PARAMETERS = "positive string, negative string, steps long, sampler string, cfg double, seed long, width int, height int, model string, model_hash string, vae string, clip_skip int, denoise double, version string"


#: Pieces between commas that are judged together; keeps the growing flags short.
_CHUNK = 256


def _walk(state: Column, piece: Column) -> Column:
    """struct(quoted, depth) after a piece of text: quotes turn, brackets outside quotes nest, whatever their kind."""
    marks = F.regexp_replace(F.translate(F.replace(piece, F.lit('\\"')), "[{]}", "(())"), r'[^()"]++', "")

    def step(held: Column, mark: Column) -> Column:
        turn = mark == '"'
        change = F.when(held["quoted"], 0).when(mark == "(", 1).when((mark == ")") & (held["depth"] > 0), -1).otherwise(0)
        return F.struct((held["quoted"] != turn).alias("quoted"), (held["depth"] + change).alias("depth"))

    return F.when(marks == "", state).otherwise(F.aggregate(F.split(marks, ""), state, step))


def split_parameters(line: Column) -> Column:
    """array<struct<key, value, raw>> of 'Key: value, ...' in order; commas in quotes and brackets, nested to any depth,
    do not part, and what is not closed runs to the end.

    The line is cut at every comma; quotes and depth are carried from piece to piece, and pieces are put together
    again where a comma does not part. No pattern repeats a group, so length and nesting cost no stack.
    """
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"))

    def judge(held: Column, piece: Column) -> Column:
        then = lambda state: F.struct(state.alias("state"), F.concat(held["flags"], F.when(~state["quoted"] & (state["depth"] == 0), "1").otherwise("0")).alias("flags"))
        return F.transform(F.array(_walk(held["state"], piece)), then)[0]

    def chunk(held: Column, pieces: Column) -> Column:
        add = lambda x: F.struct(x["state"].alias("state"), F.concat(held["flags"], F.array(x["flags"])).alias("flags"))
        return F.transform(F.array(F.aggregate(pieces, F.struct(held["state"].alias("state"), F.lit("").alias("flags")), judge)), add)[0]

    def parts_of(pieces: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _CHUNK)), lambda i: F.slice(pieces, (i * _CHUNK + 1).cast("int"), F.lit(_CHUNK)))
        flags = F.array_join(F.aggregate(chunks, F.struct(start.alias("state"), F.array().cast("array<string>").alias("flags")), chunk)["flags"], "")
        ends = F.zip_with(pieces, F.split(flags, ""), lambda piece, flag: F.concat(piece, F.when(flag == "1", "\0").otherwise(",")))
        joined = F.array_join(ends, "")
        return F.split(F.substring(joined, F.lit(1), F.length(joined) - 1), "\0")

    parts = F.flatten(F.transform(F.array(F.split(F.replace(line, F.lit("\0"), F.lit("")), ",")), parts_of))
    at = lambda p: F.instr(p, ": ")
    pair = lambda p: F.struct(F.trim(F.substring(p, F.lit(1), at(p) - 1)).alias("key"), F.btrim(F.trim(F.substring(p, at(p) + 2, F.length(p))), F.lit('"')).alias("value"), F.trim(F.substring(p, at(p) + 2, F.length(p))).alias("raw"))
    return F.filter(F.transform(F.filter(parts, lambda p: at(p) > 0), pair), lambda x: x.raw != "")


def block_lines(block: Column) -> Column:
    """struct(positive, negative, parameters): the lines of a text block by part. A line of the negative prompt or of
    parameters may begin anywhere; what follows belongs to the last part that began."""
    prepared = F.regexp_replace(F.replace(block, F.lit("\0"), F.lit("")), r"(Negative prompt: |Steps: )", "\n$1")
    lines = F.filter(F.transform(F.split(prepared, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(held: Column, line: Column) -> Column:
        negative = line.startswith("Negative prompt:")
        body = F.when(negative, F.trim(F.substring(line, F.lit(len("Negative prompt:") + 1), F.length(line)))).otherwise(line)
        begins = body.startswith(BLOCK_STARTS[0]) | body.startswith(BLOCK_STARTS[1]) | body.startswith(BLOCK_STARTS[2])
        where = F.when(begins, "parameters").when(negative, "negative").otherwise(held["where"])
        own = F.when(body != "", F.array(body)).otherwise(none)
        return F.struct(where.alias("where"), *[F.concat(held[part], F.when(where == part, own).otherwise(none)).alias(part) for part in ("positive", "negative", "parameters")])

    start = F.struct(F.lit("positive").alias("where"), *[none.alias(part) for part in ("positive", "negative", "parameters")])
    return F.aggregate(lines, start, step)


def block_metadata(block: Column) -> Column:
    """Positive prompt, negative prompt and parameters of a text block, as a struct; a key counts where it comes first."""
    return F.aggregate(F.array(block_lines(block)), F.lit(None).cast(f"struct<{PARAMETERS.replace(' ', ':')}>".replace(",:", ",")), lambda _, parts: _fields(parts))


def _fields(parts: Column) -> Column:
    # a lambda's variable, so that the lines are split once and not for every field
    split = F.array(F.flatten(F.transform(parts["parameters"], split_parameters)))
    return F.transform(split, lambda pairs: _named_fields(parts, pairs))[0]


def _named_fields(parts: Column, pairs: Column) -> Column:
    def named(key: str):
        return lambda pair: pair.key == key

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at(F.filter(pairs, named(k)), F.lit(1))["value"] for k in keys])

    def number(kind: str, *keys: str) -> Column:
        pattern = r"[+-]?\d+" if kind != "double" else r"[+-]?(\d++(\.\d*+)?+|\.\d++)([eE][+-]?\d++)?"
        value = F.trim(first(*keys))
        return F.when(value.rlike(f"^{pattern}$"), value).try_cast(kind)

    def prompt(lines: Column, between: str) -> Column:
        value = F.array_join(lines, between)
        return F.when(text.is_placeholder_prompt(value), None).otherwise(value)

    size = first("Size")
    side = lambda i: F.when(size.rlike(r"^\d+x\d+$"), F.regexp_extract(size, r"^(\d+)x(\d+)$", i)).try_cast("int")
    hashes = [first("Model hash"), first("sd_model_hash")]
    return F.struct(
        prompt(parts["positive"], "\n").alias("positive"),
        prompt(parts["negative"], " ").alias("negative"),
        number("long", "Steps").alias("steps"),
        F.nullif(F.concat_ws(" ", F.nullif(first("Sampler"), F.lit("")), F.nullif(first("Scheduler"), F.lit(""))), F.lit("")).alias("sampler"),
        number("double", "CFG scale", "CFG").alias("cfg"),
        number("long", "Seed").alias("seed"),
        side(1).alias("width"),
        side(2).alias("height"),
        first("Model", "Checkpoint", "Model name", "SD model").alias("model"),
        F.when(F.length(hashes[1]) > F.coalesce(F.length(hashes[0]), F.lit(-1)), hashes[1]).otherwise(hashes[0]).alias("model_hash"),
        first("VAE").alias("vae"),
        number("int", "Clip skip").alias("clip_skip"),
        number("double", "Denoising strength").alias("denoise"),
        first("Version").alias("version"),
    )


def parse_blocks(rows: DataFrame, block: str, keep: list[str]) -> DataFrame:
    """The kept columns with the parsed fields; null and empty blocks give nulls."""
    return rows.select(*keep, block_metadata(F.coalesce(F.col(block), F.lit(""))).alias("__m")).select(*keep, "__m.*")


def prompt_tokens(prompt: Column) -> Column:
    """struct(loras, hypernets, embeddings): the distinct references of a prompt, in order."""
    tag = lambda kind: F.array_distinct(F.regexp_extract_all(prompt, F.lit(rf"(?i)<{kind}:([^:>]+)"), 1))
    plain = F.regexp_extract_all(prompt, F.lit(r"(?i)embedding:([A-Za-z0-9_.-]+)"), 1)
    bare = F.regexp_extract_all(prompt, F.lit(r"<([A-Za-z0-9_.-]+)>"), 1)
    bare = F.transform(F.filter(bare, lambda x: ~F.lower(x).isin("lora", "hypernet")), lambda x: F.regexp_replace(x, "-", "_"))
    return F.struct(tag("lora").alias("loras"), tag("hypernet").alias("hypernets"), F.array_distinct(F.concat(plain, bare)).alias("embeddings"))


def catalog_metadata(document: Column) -> Column:
    """Fields of catalog JSON across its generations; the first present key wins.

    The fields may stand in an envelope (invokeai_metadata, sd-metadata or dream_metadata, as an object or as
    text) and in it below image or generation; weights, hash and prompts are also taken from the top level.
    """

    def get(place: Column, *paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(place, p) for p in paths])

    wrap = F.coalesce(get(document, "$.invokeai_metadata", "$['sd-metadata']", "$.dream_metadata"), document)
    root = F.coalesce(get(wrap, "$.image", "$.generation"), wrap)

    def first(*paths: str, kind: str = "string") -> Column:
        return get(root, *paths).try_cast(kind)

    prompt = get(root, "$.prompt")
    parts = F.from_json(F.when(prompt.startswith("["), prompt), "array<struct<prompt: string>>")
    prompt = F.when(prompt.startswith("["), F.array_join(F.transform(parts, lambda x: x.prompt), " ")).otherwise(prompt)
    named = lambda key: F.coalesce(first(f"$.{key}.model_name", f"$.{key}.name"), F.when(~first(f"$.{key}").startswith("{"), first(f"$.{key}")))
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.struct(
        F.coalesce(get(document, "$.model_weights"), first("$.model_weights"), named("model")).alias("model"),
        F.coalesce(get(document, "$.model_hash"), first("$.model_hash"), F.element_at(F.split(first("$.model.hash"), ":"), -1)).alias("model_hash"),
        F.coalesce(filled(prompt), filled(first("$.positive_prompt", "$.positivePrompt")), filled(get(document, "$.positivePrompt")), filled(first("$.positive_conditioning"))).alias("positive"),
        F.coalesce(first("$.negative_prompt", "$.negativePrompt"), get(document, "$.negativePrompt"), first("$.negative_conditioning")).alias("negative"),
        first("$.steps", kind="long").alias("steps"),
        first("$.seed", kind="long").alias("seed"),
        first("$.cfg_scale", "$.guidance", "$.cfg", kind="double").alias("cfg"),
        first("$.sampler", "$.scheduler", "$.sampler_name").alias("sampler"),
        F.coalesce(first("$.generation_mode", "$.generationType", "$.type"), F.when(first("$.postprocessing").isNotNull(), "postprocess")).alias("type"),
        first("$.denoising_strength", "$.denoisingStrength", "$.hrf_strength", kind="double").alias("denoise"),
        filled(named("vae")).alias("vae"),
        F.when(first("$.clip_skip", kind="int") > 0, first("$.clip_skip", kind="int")).alias("clip_skip"),
        F.when(first("$.hrf_enabled") == "true", first("$.hrf_method")).alias("upscaler"),
        F.coalesce(first("$.is_intermediate") == "true", F.lit(False)).alias("intermediate"),
    )


def video_mode(evidence: Column) -> Column:
    """Mode by the first keyword group that the titles and types of the active nodes hold."""
    low, out = F.lower(evidence), None
    for mode, words in VIDEO_MODES:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return out.otherwise("unknown")


def probe_media(document: Column) -> Column:
    """Media columns of a probe's JSON: size, duration in ms, reduced frame rate, rotation from 0 to 359."""
    kind = "struct<media: struct<track: array<map<string,string>>>>"
    tracks = F.from_json(document, kind)["media"]["track"]
    video, general = F.try_element_at(F.filter(tracks, lambda t: t["@type"] == "Video"), F.lit(1)), F.try_element_at(F.filter(tracks, lambda t: t["@type"] == "General"), F.lit(1))
    thousandths = F.round(video["FrameRate"].try_cast("double") * 1000).cast("long")
    part = F.when(thousandths % 1000 == 0, 1000).when(thousandths % 500 == 0, 500).when(thousandths % 250 == 0, 250).when(thousandths % 125 == 0, 125).when(thousandths % 10 == 0, 10).otherwise(1)
    return F.struct(
        video["Width"].try_cast("int").alias("width"),
        video["Height"].try_cast("int").alias("height"),
        F.round(F.coalesce(video["Duration"], general["Duration"]).try_cast("double") * 1000).cast("long").alias("duration_ms"),
        (thousandths / part).cast("int").alias("frame_rate_num"),
        (F.lit(1000) / part).cast("int").alias("frame_rate_den"),
        F.pmod(F.coalesce(video["Rotation"].try_cast("double"), F.lit(0.0)).cast("int"), F.lit(360)).alias("rotation"),
    )


def route(tool: Column) -> Column:
    """The parser that a tool's metadata goes to."""
    low = F.lower(F.coalesce(tool, F.lit("")))
    return F.when(low.contains("invoke"), "catalog").when(low.contains("comfy"), "graph").otherwise("block")


def strongest(candidates: Column) -> Column:
    """Of array<struct<rank int, value string>> the value of the lowest rank; null if two of that rank differ."""
    best = F.array_min(F.transform(candidates, lambda c: c["rank"]))
    values = F.array_distinct(F.transform(F.filter(candidates, lambda c: c["rank"] == best), lambda c: c["value"]))
    return F.when(F.size(values) == 1, values[0])


def evidence(candidates: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """keys, value, rank, n, conflict: of each key's candidates the value of the lowest rank (the smallest of several), how
    many values there are, and whether any differ. Null values are no evidence.

    Best rank, value and the two ends of the values are one small state that is combined before the shuffle, so a key
    with very many candidates does not meet in one task.
    """
    rows = candidates.where(F.col(value).isNotNull())
    best = F.min(F.struct(F.col(rank).alias("rank"), F.col(value).alias("value"))).alias("best")
    found = rows.groupBy(*keys).agg(best, F.count("*").alias("n"), (F.min(value) != F.max(value)).alias("conflict"))
    return found.select(*keys, "best.value", "best.rank", "n", "conflict")

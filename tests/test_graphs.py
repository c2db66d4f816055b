"""Output selection, sampler reachability and model chains of node graphs, against plain searches."""

from __future__ import annotations

import json
import random

import pytest

from loomery.operators import graphs


def node(kind, mode=0, **inputs):
    return {"class_type": kind, "mode": mode, "inputs": {k: [str(v[0]), 0] if isinstance(v, tuple) else v for k, v in inputs.items()}}


def table(spark, workflows):
    rows = [(k, w if w is None or isinstance(w, str) else json.dumps(w)) for k, w in workflows.items()]
    return spark.createDataFrame(rows, "id string, workflow string")


def selected(spark, workflows):
    return {r.graph: (list(r.outputs), list(r.roots), r.ambiguous) for r in graphs.selection(table(spark, workflows), "id", "workflow").collect()}


GRAPHS = {
    "plain": {"9": node("SaveImage", images=(8,)), "8": node("VAEDecode", samples=(3,)), "3": node("KSampler", latent_image=(5,)), "5": node("EmptyLatentImage")},
    "two samplers in a row": {"9": node("SaveImage", images=(8,)), "8": node("VAEDecode", samples=(10,)), "10": node("KSampler", latent_image=(11,)), "11": node("LatentUpscale", samples=(3,)), "3": node("KSamplerAdvanced", latent_image=(5,)), "5": node("EmptyLatentImage")},
    "through pixels": {"9": node("SaveImage", images=(8,)), "8": node("VAEDecode", samples=(10,)), "10": node("KSampler", latent_image=(11,)), "11": node("VAEEncodeTiled", pixels=(12,)), "12": node("ImageScale", image=(13,)), "13": node("VAEDecode", samples=(3,)), "3": node("SamplerCustom")},
    "ambiguous": {"9": node("SaveImage", images=(8,)), "7": node("Image Save", images=(6,)), "8": node("VAEDecode", samples=(3,)), "6": node("VAEDecode", samples=(4,)), "3": node("KSampler"), "4": node("KSampler")},
    "save before preview": {"9": node("SaveImage", images=(3,)), "7": node("PreviewImage", images=(4,)), "3": node("KSampler"), "4": node("KSampler")},
    "preview alone": {"7": node("PreviewImage", images=(4,)), "4": node("KSampler")},
    "muted save": {"9": node("SaveImage", 2, images=(3,)), "8": node("SaveImage", 4, images=(3,)), "7": node("PreviewImage", images=(4,)), "3": node("KSampler"), "4": node("KSampler")},
    "cycle of images": {"9": node("SaveImage", images=(8,)), "8": node("ImageScale", image=(7,)), "7": node("ImageScale", image=(8,), pixels=(3,)), "3": node("KSampler")},
    "cycle of samplers": {"9": node("SaveImage", images=(1,)), "1": node("KSampler", latent_image=(2,)), "2": node("KSampler", samples=(1,))},
    "reroute": {"9": node("SaveImage", images=(8,)), "8": {"class_type": "Reroute", "inputs": {"": ["3", 0], "image": ["4", 0]}}, "3": node("KSampler"), "4": node("KSampler")},
    "no sampler": {"9": node("SaveImage", images=(8,)), "8": node("LoadImage")},
    "link to nothing": {"9": node("SaveImage", images=(77,)), "8": node("KSampler")},
    "select is no sampler": {"9": node("SaveImage", images=(8,)), "8": node("KSamplerSelect", image=(3,)), "3": node("SamplerCustomAdvanced")},
    "numbers sort as numbers": {"10": node("SaveImage", images=(3,)), "9": node("SaveImage", images=(3,)), "b": node("SaveImage", images=(3,)), "3": node("KSampler")},
    "null": None,
    "text": "no json",
    "list": "[1]",
    "empty": {},
}


def test_selection(spark):
    got = selected(spark, GRAPHS)
    assert got == {
        "plain": (["9"], ["3"], False),
        "two samplers in a row": (["9"], ["3"], False),
        "through pixels": (["9"], ["3"], False),
        "ambiguous": (["7", "9"], ["3", "4"], True),
        "save before preview": (["9"], ["3"], False),
        "preview alone": (["7"], ["4"], False),
        "muted save": (["7"], ["4"], False),
        "cycle of images": (["9"], ["3"], False),
        "cycle of samplers": (["9"], ["1"], False),
        "reroute": (["9"], ["3"], False),
        "no sampler": (["9"], [], False),
        "select is no sampler": (["9"], ["3"], False),
        "numbers sort as numbers": (["9", "10", "b"], ["3"], False),
    }


def test_meeting_paths_do_not_multiply(spark):
    """Forty pairs of nodes, each fed by both of the next pair: two to the fortieth paths."""
    wide = {"0": node("SaveImage", images=("1a",))}
    for i in range(1, 41):
        for side in "ab":
            wide[f"{i}{side}"] = node("ImageBlend", image=(f"{i + 1}a",), pixels=(f"{i + 1}b",))
    wide["41a"], wide["41b"] = node("KSampler"), node("KSampler")
    assert selected(spark, {"g": wide}) == {"g": (["0"], ["41a", "41b"], True)}


def test_depth_ends_long_paths(spark):
    def line(n):
        return {"0": node("SaveImage", images=(1,))} | {str(i): node("ImageScale", image=(i + 1,)) for i in range(1, n)} | {str(n): node("KSampler")}

    assert selected(spark, {"in": line(50), "out": line(51)}) == {"in": (["0"], ["50"], False), "out": (["0"], [], False)}


def brute_chain(workflow, start, limit):
    names, at, seen = [], start, set()
    for _ in range(limit):
        if at in seen:
            return names, None, False
        seen.add(at)
        inputs = workflow[at]["inputs"]
        if isinstance(inputs.get("lora_name"), str) and inputs["lora_name"] not in names:
            names.append(inputs["lora_name"])
        if isinstance(inputs.get("ckpt_name"), str):
            return names, inputs["ckpt_name"], True
        link = inputs.get("model")
        if link is None or link[0] not in workflow:
            return names, None, True
        at = link[0]
    return names, None, False


@pytest.mark.parametrize("limit", [20, 64])
def test_chains_equal_a_plain_walk(spark, limit):
    rng = random.Random(2)
    workflows = {}
    for n in (1, 2, 3, 19, 20, 21, 50, 63, 64, 65):
        for end in ("model", "nothing", "missing", "cycle"):
            w = {"s": node("KSampler", model=(0,))}
            for i in range(n):
                to = {} if i < n - 1 or end == "nothing" else {"missing": {"model": (999,)}, "cycle": {"model": (rng.randrange(n),)}}.get(end, {})
                to = {"model": (i + 1,)} if i < n - 1 else to
                w[str(i)] = node("LoraLoader", lora_name=f"l{i % 40}", **to) if rng.random() < 0.7 else node("ModelSampling", **to)
            if end == "model":
                w[str(n - 1)] = node("UNETLoader", ckpt_name="base", model=(0,))
            workflows[f"{n}-{end}"] = w
    got = {r.graph: (list(r.loras), r.model, r.whole) for r in graphs.models(table(spark, workflows), "id", "workflow", limit).collect()}
    assert got == {k: brute_chain(w, "0", limit) for k, w in workflows.items()}


def test_chain_inputs_names_and_reroutes(spark):
    g = {
        "s": node("KSampler", model=(4,), seed=5),
        "4": node("LoraLoader", lora_name="dir/First.safetensors", model=(3,), clip=(9,)),
        "3": {"class_type": "Reroute", "inputs": {"": ["2", 0]}},
        "2": node("LoraLoaderModelOnly", lora_name="Second.pt", MODEL=(1,), VAE=(9,)),
        "1": node("CheckpointLoaderSimple", ckpt_name="deep\\Base_model.ckpt"),
        "9": node("UNETLoader", unet_name="other"),
    }
    (r,) = graphs.models(table(spark, {"g": g}), "id", "workflow").collect()
    assert (r.sampler, list(r.loras), r.model, r.whole) == ("s", ["First", "Second"], "Base_model", True)
    assert graphs.models(table(spark, {"n": None, "e": {}}), "id", "workflow").collect() == []

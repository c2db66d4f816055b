"""The search language and the structured filter, compiled to Column predicates and semi joins."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import dates, text

_TOKEN = re.compile(r'([-!])?("(?:[^"\\]|\\.)*"|\S+)')
_KEYED = re.compile(r"([A-Za-z]+):(.*)", re.S)
_NUMBER = re.compile(r"[<>=]?\s*-?\d+(?:\.\d+)?")
NUMERIC = {"steps": "steps", "cfg": "cfg", "w": "width", "width": "width", "h": "height", "height": "height"}
BRIDGES = {"lora": "loras", "cn": "controlnets", "controlnet": "controlnets", "ip": "ip_adapters", "ipadapter": "ip_adapters"}
PARTS = {"neg": ["negative"], "negative": ["negative"], "file": ["path"], "filename": ["path"], "path": ["path"], "all": ["path", "json"], "sampler": ["sampler"], "tool": ["tool"], "seed": ["seed"], "model": ["model", "json_model"]}


@dataclass(frozen=True)
class Fields:
    """Columns that play the roles of the language; a role without a column makes its keys match nothing."""

    id: str
    prompt: str | None = None
    negative: str | None = None
    path: str | None = None
    json: str | None = None
    model: str | None = None
    sampler: str | None = None
    tool: str | None = None
    seed: str | None = None
    steps: str | None = None
    cfg: str | None = None
    width: str | None = None
    height: str | None = None
    timestamp: str | None = None
    # boolean columns of the default scope
    deleted: str | None = None
    intermediate: str | None = None
    grid: str | None = None
    source_asset: str | None = None
    owner_hidden: str | None = None
    privacy_hidden: str | None = None

    def column(self, role: str) -> Column | None:
        if role == "json_model":
            return F.get_json_object(F.col(self.json), "$.model") if self.json else None
        name = getattr(self, role)
        return F.col(name) if name else None


@dataclass(frozen=True)
class Token:
    text: str
    negated: bool = False
    quoted: bool = False
    key: str | None = None


@dataclass
class Semi:
    """Keep (or drop) assets that the bridge's rows under condition name."""

    kind: str
    condition: Column
    negated: bool = False


@dataclass
class Compiled:
    predicate: Column | None = None
    semis: list[Semi] = field(default_factory=list)

    def apply(self, assets: DataFrame, asset_id: str, bridge: DataFrame | None = None) -> DataFrame:
        """bridge: (asset_id, kind, name). Each semi join sees the bridge filtered to its kind and name."""
        out = assets if self.predicate is None else assets.filter(self.predicate)
        for semi in self.semis:
            ids = bridge.filter((F.col("kind") == semi.kind) & semi.condition).select(F.col("asset_id").alias(asset_id))
            out = out.join(ids, asset_id, "left_anti" if semi.negated else "left_semi")
        return out


def tokenize(query: str) -> list[Token]:
    """Terms, quoted phrases (always literal) and key:value tokens, each with an optional - or ! before."""
    out = []
    for sign, body in _TOKEN.findall(query or ""):
        quoted = len(body) > 1 and body[0] == body[-1] == '"'
        if quoted:
            out.append(Token(re.sub(r"\\(.)", r"\1", body[1:-1]), bool(sign), True))
            continue
        keyed = _KEYED.fullmatch(body)
        if keyed and keyed[2]:
            out.append(Token(keyed[2].strip('"'), bool(sign), False, keyed[1].lower()))
        else:
            out.append(Token(body, bool(sign)))
    return [t for t in out if t.text]


def validate(query: str) -> tuple[str, str]:
    """('ready' | 'pending' | 'invalid', reason) before a query runs."""
    if (query or "").count('"') % 2:
        return "pending", "a quote is open"
    if re.search(r"(?:^|\s)[-!]?[A-Za-z]+:$", query or ""):
        return "pending", "a key has no value yet"
    for token in tokenize(query):
        if token.key in NUMERIC and not _NUMBER.fullmatch(token.text):
            return "invalid", f"{token.key} needs a number"
        if token.key in ("date", "after", "before") and dates.search_bounds(token.key, token.text) is None:
            return "invalid", f"{token.key} needs a date"
    return "ready", ""


def contains(column: Column, term: str) -> Column:
    """Literal, case-insensitive."""
    return F.contains(F.lower(column.cast("string")), F.lit(term.lower()))


def within(column: Column, bounds: dates.Bounds) -> Column:
    parts = []
    if bounds.start is not None:
        parts.append(column >= dates.moment(bounds.start))
    if bounds.end is not None:
        parts.append(column < dates.moment(bounds.end))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _condition(token: Token, fields: Fields) -> Column | Semi | None:
    key, value = token.key, token.text
    if key in NUMERIC:
        column, sign = fields.column(NUMERIC[key]), value[0] if value[0] in "<>=" else "="
        if column is None or not _NUMBER.fullmatch(value):
            return F.lit(False)
        number = F.lit(float(value.lstrip("<>=")))
        found = column > number if sign == ">" else column < number if sign == "<" else column == number
    elif key in ("date", "after", "before"):
        bounds = dates.search_bounds(key, value)
        found = F.lit(False) if bounds is None or fields.timestamp is None else within(F.col(fields.timestamp), bounds)
    elif key in BRIDGES:
        return Semi(BRIDGES[key], contains(F.col("name"), value), token.negated)
    elif key == "upscaled":
        if fields.json is None or value.lower() not in ("true", "false"):
            return F.lit(False)
        found = F.get_json_object(F.col(fields.json), "$.upscaled") == value.lower()
    elif key in PARTS:
        columns = [c for c in map(fields.column, PARTS[key]) if c is not None]
        if token.negated and len(columns) > 1:
            return reduce(lambda a, b: a & b, [~contains(c, value) for c in columns])
        found = reduce(lambda a, b: a | b, [contains(c, value) for c in columns], F.lit(False)) if columns else F.lit(False)
    elif key is not None:
        return None  # unknown keys are dropped
    else:
        column = fields.column("prompt")
        found = F.lit(False) if column is None else contains(column, value)
    return ~found if token.negated else found


def compile_query(query: str, fields: Fields) -> Compiled:
    """Conditions are joined by AND; OR holds only between two adjacent positive plain terms."""
    tokens, out, i = tokenize(query), Compiled(), 0
    plain = [t.key is None and not t.negated for t in tokens]
    is_or = [t.text == "OR" and not t.quoted and t.key is None and not t.negated for t in tokens]
    parts: list[Column] = []
    while i < len(tokens):
        if is_or[i]:
            i += 1
            continue
        found = _condition(tokens[i], fields)
        if plain[i]:
            while i + 2 < len(tokens) and is_or[i + 1] and plain[i + 2] and not is_or[i + 2]:
                found, i = found | _condition(tokens[i + 2], fields), i + 2
        if isinstance(found, Semi):
            out.semis.append(found)
        elif found is not None:
            parts.append(found)
        i += 1
    out.predicate = reduce(lambda a, b: a & b, parts) if parts else None
    return out


@dataclass(frozen=True)
class FilterState:
    """The structured filter. Names in resources may have aliases: {kind: [(name, alias, ...), ...]}."""

    query: str = ""
    media_type: str | None = None
    favorites: bool = False
    pinned: bool = False
    models: tuple[tuple[str, ...], ...] = ()
    tools: tuple[str, ...] = ()
    tools_mode: str = "any"
    resources: dict[str, tuple[tuple[str, ...], ...]] = field(default_factory=dict)
    resources_mode: str = "any"
    steps: tuple[float | None, float | None] = (None, None)
    cfg: tuple[float | None, float | None] = (None, None)
    samplers: tuple[str, ...] = ()
    generation_types: tuple[str, ...] = ()
    date_preset: str | None = None
    date_start: str | None = None
    date_end: str | None = None
    collection: str | None = None
    excluded_ids: tuple = ()
    show_intermediates: bool = False
    show_grids: bool = False
    show_assets: bool = False
    hide_private: bool = False


@dataclass(frozen=True)
class Tables:
    """Side tables of a filter: bridge (asset_id, kind, name), membership (collection_id, asset_id) and excluded
    (asset_id), for exclusions that are too many for a list."""

    bridge: DataFrame | None = None
    membership: DataFrame | None = None
    excluded: DataFrame | None = None
    smart: dict[str, FilterState] = field(default_factory=dict)


def _any_or_unknown(column: Column, names: Iterable[str]) -> Column:
    wanted = [n.lower() for n in names]
    found = F.lower(column).isin([n for n in wanted if n != "unknown"])
    return F.coalesce(found, F.lit(False)) | column.isNull() | F.lower(column).isin("", "unknown") if "unknown" in wanted else found


def visible_scope(fields: Fields, state: FilterState) -> Column:
    """The default scope: not deleted, not hidden from the owner, without intermediates, grids and source assets
    unless shown, without private ones if they are to be hidden. Unknown values stay visible."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name else F.lit(False)
    hidden = [(fields.deleted, False), (fields.owner_hidden, False), (fields.intermediate, state.show_intermediates), (fields.grid, state.show_grids), (fields.source_asset, state.show_assets), (fields.privacy_hidden, not state.hide_private)]
    return reduce(lambda a, b: a & b, [~flag(name) for name, shown in hidden if name and not shown], F.lit(True))


def apply_filter(assets: DataFrame, state: FilterState, fields: Fields, tables: Tables | None = None, *, now: datetime | None = None, exclude: Iterable[str] = (), generation: str = "generation_type", media: str = "media_type", favorite: str = "is_favorite", pin: str = "is_pinned") -> DataFrame:
    """assets under the filter. exclude names categories left out, for disjunctive facets:
    models, tools, samplers, generation_types or a resource kind."""
    tables, left_out = tables or Tables(), set(exclude)
    out = assets.filter(visible_scope(fields, state))
    if state.collection in tables.smart:
        inner = tables.smart[state.collection]
        if state.date_preset:  # an own date overrides the smart collection's
            inner = replace(inner, date_preset=None)
        # what is shown is decided by the outer filter
        inner = replace(inner, show_intermediates=True, show_grids=True, show_assets=True, hide_private=False)
        out = apply_filter(out, inner, fields, tables, now=now, generation=generation, media=media, favorite=favorite, pin=pin)
    elif state.collection is not None:
        members = tables.membership.filter(F.col("collection_id") == state.collection).select(F.col("asset_id").alias(fields.id))
        out = out.join(members, fields.id, "left_semi")
    out = compile_query(state.query, fields).apply(out, fields.id, tables.bridge)
    if state.excluded_ids:
        out = out.filter(~F.col(fields.id).isin(list(state.excluded_ids)))
    if tables.excluded is not None:
        out = out.join(tables.excluded.select(F.col("asset_id").alias(fields.id)), fields.id, "left_anti")
    if state.media_type:
        out = out.filter(F.col(media) == state.media_type)
    if state.favorites:
        out = out.filter(F.col(favorite))
    if state.pinned:
        out = out.filter(F.col(pin))
    if state.models and "models" not in left_out:
        out = out.filter(_any_or_unknown(F.col(fields.model), [a for m in state.models for a in m]))
    if state.tools and "tools" not in left_out:
        column = F.col(fields.tool)
        out = out.filter(_any_or_unknown(column, state.tools) if state.tools_mode == "any" else reduce(lambda a, b: a & b, [_any_or_unknown(column, [t]) for t in state.tools]))
    for kind, items in state.resources.items():
        if items and kind not in left_out:
            out = having_resources(out, fields.id, tables.bridge, kind, items, state.resources_mode)
    for (lo, hi), role in ((state.steps, fields.steps), (state.cfg, fields.cfg)):
        if lo is not None:
            out = out.filter(F.col(role) >= lo)
        if hi is not None:
            out = out.filter(F.col(role) <= hi)
    if state.samplers and "samplers" not in left_out:
        wanted = [re.sub("[_-]", " ", s.lower()).strip() for s in state.samplers]
        out = out.filter(text.normalize_sampler(F.col(fields.sampler)).isin(wanted))
    if state.generation_types and "generation_types" not in left_out:
        out = out.filter(F.col(generation).isin(list(state.generation_types)))
    if state.date_preset:
        out = out.filter(within(F.col(fields.timestamp), dates.preset_bounds(state.date_preset, now or datetime.now(timezone.utc).replace(tzinfo=None), state.date_start, state.date_end)))
    return out


def having_resources(assets: DataFrame, asset_id: str, bridge: DataFrame, kind: str, items: Iterable[tuple[str, ...]], mode: str = "any") -> DataFrame:
    """Assets with any or all of the items; an item is a name with its aliases, compared canonically."""
    items = list(items)
    pairs = [(alias.lower(), i) for i, item in enumerate(items) for alias in item]
    rows = bridge.filter(F.col("kind") == kind).withColumn("ref", F.lower(text.canonical_reference(F.col("name"))))
    rows = rows.filter(F.col("ref").isin([a for a, _ in pairs])).select(F.col("asset_id").alias(asset_id), "ref")
    if mode == "all":
        index = F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])
        rows = rows.groupBy(asset_id).agg(F.countDistinct(index[F.col("ref")]).alias("n")).filter(F.col("n") == len(items)).select(asset_id)
    return assets.join(rows.select(asset_id), asset_id, "left_semi")


def parse_chips(line: str) -> tuple[FilterState, str]:
    """lora:, model: and tool: chips of a line as a filter, and the rest of the line."""
    loras, models, tools, rest = [], [], [], []
    for token in tokenize(line):
        if not token.negated and token.key in ("lora", "model", "tool"):
            {"lora": loras, "model": models, "tool": tools}[token.key].append((token.text,))
        else:
            sign, body = "-" if token.negated else "", f'"{token.text}"' if token.quoted else token.text
            rest.append(f"{sign}{token.key}:{body}" if token.key else sign + body)
    state = FilterState(models=tuple(models), tools=tuple(t for (t,) in tools), resources={"loras": tuple(loras)} if loras else {})
    return state, " ".join(rest)

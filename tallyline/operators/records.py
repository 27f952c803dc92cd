"""Checks of JSON documents and of the evidence beside them: sidecars, model provenance and binding, frozen selections, paired pictures, parameters.

Documents are read as variants, so a type counts as written: "true" is no boolean, and a field that is null isn't one that is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conflicts import held, issues, repeated, visual_seed

# Fixed values of the documents' formats.
CAPTURE_TYPES = ("real_webcam", "pre_cropped", "public_talk", "unknown")
CONTENT_STYLES = ("everyday_conversation", "spontaneous_speech", "read_speech", "unknown")
SIDECAR_FIELDS = ("provenance", "metadata_verified", "scene", "capture_type", "content_style")
PRESETS = ("identity", "stabilize_mild", "stabilize_moderate")
BINDING_FIELDS = ("name", "language", "checkpoint_sha256", "configuration_sha256", "vocabulary_sha256", "file_sha256", "adapter", "beam_size", "ctc_weight", "nbest", "reverse_weight", "length_bonus", "external_lm", "personal", "decoder_weights", "encoder_device", "decoder_device")
BINDING_DEFAULTS = {"pre_beam_ratio": "1.5", "reverse_scoring": "sequential", "reverse_tie_tolerance": "0.001"}


class Document:
    """Typed access to the fields of a parsed JSON text; what isn't JSON (null) has no fields."""

    def __init__(self, variant: Column, kinds: dict[str, Column]) -> None:
        self.variant, self.kinds = variant, kinds

    def kind(self, path: str = "") -> Column:
        """The type of a field as written; VOID for null, null where there is none."""
        return self.kinds.setdefault(path, F.schema_of_variant(F.try_variant_get(self.variant, f"${path}", "variant")))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.variant, f"${path}", "string"))

    def number(self, path: str) -> Column:
        return F.when(numeric(self.kind(path)), F.try_variant_get(self.variant, f"${path}", "double"))

    def whole(self, path: str) -> Column:
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.variant, f"${path}", "long"))

    def fields(self, path: str) -> Column:
        """An object's fields as a map of variants."""
        return F.when(self.is_object(path), F.try_variant_get(self.variant, f"${path}", "map<string,variant>"))

    def is_object(self, path: str = "") -> Column:
        return holds(F.startswith(self.kind(path), F.lit("OBJECT")))

    def has(self, path: str) -> Column:
        return self.kind(path).isNotNull()

    def filled(self, path: str) -> Column:
        return holds(F.trim(self.text(path)) != "")

    def digest(self, path: str) -> Column:
        return holds(self.text(path).rlike("^[0-9a-f]{64}$"))


def read(json: Column, use: Callable[[Document], Column]) -> Column:
    """What ``use`` makes of a JSON text, which is made and parsed once for all fields, and of whose fields each type is looked up once.

    A lambda's argument is computed once, an expression for each of its uses; which types are needed is found by a first call of ``use``."""
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    needed: dict[str, Column] = {}
    use(Document(F.lit(None), needed))
    names = {path: f"k{i}" for i, path in enumerate(needed)}

    def typed(v: Column) -> Column:
        plain = Document(v, {})
        return F.struct(v.alias("v"), *(plain.kind(path).alias(name) for path, name in names.items()))

    return once(once(F.try_parse_json(json), typed), lambda s: use(Document(s["v"], {path: s[name] for path, name in names.items()})))


def _listed(rows: DataFrame, key: str, json: Column, checks: Callable[[Document], dict[str, Column]]) -> DataFrame:
    """(key, issue): a row for each check of the document that holds."""
    return rows.select(key, F.explode(read(json, lambda d: held(checks(d)))).alias("issue"))


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def numeric(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def sidecar_issues(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, issue) of metadata records (id, record) that don't fit their manifest rows (id, domain; null: unknown).

    A record is an object of known fields only, about a known id; provenance and, if given, scene are not blank, metadata_verified is a boolean, capture_type and
    content_style are known values. A real webcam's row is of the domain webcam, a cropped one's of mouth_roi. Rows of the manifest are counted by id first."""
    rows = records.join(manifest.groupBy("id").agg(F.coalesce(F.min("domain"), F.lit("unknown")).alias("_domain")), "id", "left")
    foreign = F.size(F.array_except(F.json_object_keys("record"), F.array(*map(F.lit, SIDECAR_FIELDS)))) > 0

    def checks(d: Document) -> dict[str, Column]:
        of = lambda field, known: d.has(f".{field}") & ~holds(d.text(f".{field}").isin(*known))
        capture = d.text(".capture_type")
        is_object = d.is_object()
        return {
            "record": ~is_object, "unknown id": F.col("_domain").isNull(), "field": is_object & foreign, "provenance": is_object & ~d.filled(".provenance"), "verified": is_object & ~holds(d.kind(".metadata_verified") == "BOOLEAN"),
            "scene": d.has(".scene") & ~d.filled(".scene"), "capture_type": of("capture_type", CAPTURE_TYPES), "content_style": of("content_style", CONTENT_STYLES),
            "webcam": (capture == "real_webcam") & (F.col("_domain") != "webcam"), "cropped": (capture == "pre_cropped") & (F.col("_domain") != "mouth_roi")}

    return _listed(rows, "id", F.col("record"), checks)


def _provenance(d: Document, language: str) -> dict[str, Column]:
    model = d.is_object()
    weight = lambda f: d.has(f) & (d.kind(f) != "VOID")
    sound = lambda f: ~weight(f) | d.digest(f)
    beam, nbest = d.whole(".beam_size"), d.whole(".nbest")
    pool = F.when(d.has(".candidate_pool_size"), d.whole(".candidate_pool_size")).otherwise(nbest)
    shortlist = F.when(d.has(".pre_beam_ratio"), d.number(".pre_beam_ratio")).otherwise(1.5)
    bound = holds((d.text(".adapter.base_checkpoint_sha256") == d.text(".checkpoint_sha256")) & (d.whole(".adapter.schema_version") == 1) & (d.text(".adapter.language") == language)) & d.digest(".adapter.file_sha256") & d.digest(".adapter.base_checkpoint_sha256")
    named = d.fields(".decoder_weights")
    weights = holds((F.size(named) > 0) & F.forall(F.map_keys(named), lambda k: F.trim(k) != "") & F.forall(F.map_values(named), lambda v: numeric(F.schema_of_variant(v))))
    checks = {
        **{f: ~d.filled(f".{f}") for f in ("name", "encoder_device", "decoder_device")}, "language": ~holds(d.text(".language") == language),
        "weights": ~(weight(".checkpoint_sha256") | weight(".file_sha256")) | ~sound(".checkpoint_sha256") | ~sound(".file_sha256"),
        **{f: ~d.digest(f".{f}") for f in ("configuration_sha256", "vocabulary_sha256")}, "adapter": ~holds(d.kind(".adapter") == "VOID") & ~bound,
        "search": ~holds((beam >= pool) & (pool >= nbest) & (nbest >= 1)), "ratio": ~holds((shortlist >= 1) & (shortlist <= 4)), **{f: ~holds(d.number(f".{f}").between(0, 1)) for f in ("ctc_weight", "reverse_weight")},
        "length_bonus": d.number(".length_bonus").isNull(), **{f: ~holds(d.kind(f".{f}") == "BOOLEAN") for f in ("external_lm", "personal")}, "decoder_weights": d.has(".decoder_weights") & ~weights,
        "reverse_scoring": d.has(".reverse_scoring") & ~holds(d.text(".reverse_scoring").isin("sequential", "batched")), "tolerance": d.has(".reverse_tie_tolerance") & ~holds(d.number(".reverse_tie_tolerance") >= 0)}
    return {"model": ~model} | {k: model & v for k, v in checks.items()}


def provenance_issues(reports: DataFrame, language: str) -> DataFrame:
    """(id, issue): what keeps a report's model (id, model) from being compared. Nothing that is missing counts as equal to something missing.

    Wanted are name and devices, the language, a weight digest (each given one sound), digests of configuration and vocabulary; adapter, null or bound to the same
    checkpoint; beam >= pool >= nbest >= 1 (pool: nbest by default) and a shortlist ratio of 1 to 4; weights in [0, 1], a number as length bonus, the two
    switches; if given, decoder weights that are named numbers, a known way of reverse scoring and a tolerance that isn't negative."""
    return _listed(reports, "id", F.col("model"), lambda d: _provenance(d, language))


def model_binding(model: Column) -> Column:
    """What must be equal for two reports to be of one model and search, as text; null for what is no object.

    Numbers count by value, whichever way they are written; in objects inside (adapter, decoder_weights) as they are written, fields in any order. Older documents
    lack the pool (nbest), the shortlist ratio, the way of reverse scoring and its tolerance: the defaults stand for fields that are missing, not for nulls."""
    return read(model, _binding)


def comparable_binding(model: Column, language: str) -> Column:
    """The binding of a model that nothing keeps from being compared; null for others."""
    return read(model, lambda d: F.when(F.size(held(_provenance(d, language))) == 0, _binding(d)))


def _binding(d: Document) -> Column:
    def value(field: str) -> Column:
        path = f".{field}"
        return F.when(numeric(d.kind(path)), d.number(path).cast("string")).when(d.kind(path) == "STRING", d.text(path)).otherwise(F.to_json(F.try_variant_get(d.variant, f"${path}", "variant")))

    own = {f: F.coalesce(value(f), F.lit("null")) for f in BINDING_FIELDS}
    later = {f: F.when(d.has(f".{f}"), value(f)).otherwise(x) for f, x in BINDING_DEFAULTS.items()}
    pool = F.when(d.has(".candidate_pool_size"), value("candidate_pool_size")).otherwise(value("nbest"))
    return F.when(d.is_object(), F.to_json(F.struct(*(x.alias(f) for f, x in (own | later | {"candidate_pool_size": pool}).items()))))


def selection_issues(documents: DataFrame) -> DataFrame:
    """(id, issue) of documents (id, document) that freeze a choice of preprocessing: of schema 1, made on the development part alone, test explicitly unused, a known preset,
    and digests of the reports it was made from: provenance.dev_report_sha256 or, if there are none in it, input_sha256."""

    def checks(d: Document) -> dict[str, Column]:
        own, older = d.fields(".provenance.dev_report_sha256"), d.fields(".input_sha256")
        sound = lambda m: holds((F.size(m) > 0) & F.forall(F.map_values(m), lambda v: holds((F.schema_of_variant(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike("^[0-9a-f]{64}$"))))
        given = d.has(".provenance.dev_report_sha256") & (d.kind(".provenance.dev_report_sha256") != "VOID") & ~holds(F.size(own) == 0)
        parent = d.has(".provenance") & ~d.is_object(".provenance")
        unused = F.try_variant_get(d.variant, "$.test_used_for_selection", "boolean")
        return {
            "schema": ~holds(d.whole(".schema_version") == 1), "partition": ~holds(d.text(".selection_partition") == "dev"), "test used": ~holds((d.kind(".test_used_for_selection") == "BOOLEAN") & ~unused),
            "preset": ~holds(d.text(".selected_preprocessing").isin(*PRESETS)), "reports": parent | ~F.when(given, sound(own)).otherwise(sound(older))}

    return _listed(documents, "id", F.col("document"), checks)


def picture_issues(left: DataFrame, right: DataFrame, seeds: tuple[int, int], configurations: tuple[str, str]) -> DataFrame:
    """(id, issue) of two runs' evidence (id, error, configuration, original, input, shape, dtype, seed) that keeps them from being compared.

    A row without evidence (configuration null) is fine if it failed (error not blank), and then says nothing about its pair. Other rows need the run's configuration, two
    digests, a shape of three sizes over 0 in uint8, and the seed that the run's and the id give; what they had before preprocessing must be equal. An id in one run alone is unpaired."""
    columns = ("error", "configuration", "original", "input", "shape", "dtype", "seed")
    a, b = (df.select("id", F.struct(*columns).alias(side)) for df, side in ((left, "a"), (right, "b")))
    both = a.join(b, "id", "full")
    there = {s: F.col(f"{s}.configuration").isNotNull() for s in "ab"}
    checks = {"unpaired": F.col("a").isNull() | F.col("b").isNull()}
    for side, seed, configuration in zip("ab", seeds, configurations, strict=True):
        c = {x: F.col(f"{side}.{x}") for x in columns}
        failed = holds(c["error"] != "")
        sizes = holds((F.size(c["shape"]) == 3) & F.forall(c["shape"], lambda x: holds(x > 0)) & (c["dtype"] == "uint8"))
        checks |= {
            f"{side} evidence": F.col(side).isNotNull() & F.when(there[side], c["configuration"] != configuration).otherwise(~failed), f"{side} digest": there[side] & ~holds(c["original"].rlike("^[0-9a-f]{64}$") & c["input"].rlike("^[0-9a-f]{64}$")),
            f"{side} shape": there[side] & ~sizes, f"{side} seed": there[side] & ~holds(c["seed"] == visual_seed(F.col("id").cast("string"), seed))}
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("original", "shape", "dtype", "seed")]
    checks["different"] = there["a"] & there["b"] & ~(same[0] & same[1] & same[2] & same[3])
    return issues(both, "id", checks)


def parameter_issues(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(model, name, issue) of a model's parameters (model, name, shape, dtype; found also finite) that don't match those expected: missing, unexpected, repeated, or of another
    shape or type, or not finite. Both sides meet on model and name; a null shape or type is none, a null key meets nothing, of repeated ones the smallest shape counts."""
    keys = ["model", "name"]
    have = repeated(found, keys, "_twice").groupBy(*keys).agg(F.min(F.struct("shape", "dtype")).alias("_f"), F.bool_and(holds(F.col("finite"))).alias("_finite"), F.bool_or("_twice").alias("_twice"))
    want = expected.select(*keys, F.struct("shape", "dtype").alias("_e")).dropDuplicates(keys)
    both = want.join(have, keys, "full").withColumn("_key", F.struct(*keys))
    there = F.col("_e").isNotNull() & F.col("_f").isNotNull()
    return issues(both, "_key", {
        "missing": F.col("_f").isNull(), "unexpected": F.col("_e").isNull(), "repeated": F.col("_twice"), "shape": there & ~holds(F.col("_e.shape") == F.col("_f.shape")),
        "type": there & ~holds(F.col("_e.dtype") == F.col("_f.dtype")), "not finite": F.col("_f").isNotNull() & ~F.col("_finite")}).select("_key.*", "issue")

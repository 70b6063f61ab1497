"""Text rules as column expressions; they stay in the JVM and read nothing but their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _first(cases: list[tuple[Column, object]], default) -> Column:
    """The value of the first case that holds."""
    (test, value), *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(test, value)).otherwise(default)


def search_text(value: Column) -> Column:
    """CamelCase and ACRONYMWord split, lower case, separators and marks to single spaces."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, r"([A-Z])([A-Z][a-z])", "$1 $2")
    text = F.regexp_replace(F.lower(text), r"[_/]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\pL\pN_\-+. ]+", " "), r"\s+", " "))


def constructs(value: Column, broad: bool = False) -> Column:
    """Sorted names of the phrase rules that match; assessments of other kinds don't count as grading alone."""
    text = search_text(value)
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.regexp(text, F.lit(p)), F.lit(n)) for n, p in (*rules.STRICT_CONSTRUCTS, *(rules.BROAD_CONSTRUCTS if broad else ()))])))
    other = reduce(lambda a, b: a | b, [F.regexp(text, F.lit(p)) for p in rules.OTHER_ASSESSMENTS])
    return F.when((found == F.array(F.lit("grading_support"))) & other, F.array().cast("array<string>")).otherwise(found)


def field_constructs(fields: Column, broad: bool = False) -> Column:
    """Constructs of several fields, each matched for itself so that no phrase spans two."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, lambda f: constructs(f, broad)))))


def namespace(model: Column) -> Column:
    return F.when(F.instr(model, "/") > 0, F.trim(F.split_part(model, F.lit("/"), F.lit(1)))).otherwise("unscoped")


def model_provider(model: Column, bases: Column) -> Column:
    """(provider, basis) of the first base, then the model itself, in a known namespace; else the public namespace."""
    known = F.create_map(*[F.lit(x) for pair in rules.NAMESPACES.items() for x in pair])
    empty = F.array().cast("array<string>")
    candidates = F.concat(F.coalesce(bases, empty), F.array(model))
    hits = F.filter(F.transform(candidates, lambda c: F.struct(F.try_element_at(known, F.lower(namespace(c))).alias("p"), (c != model).alias("base"))), lambda x: x["p"].isNotNull())
    hit = F.try_element_at(hits, F.lit(1))
    return F.when(hit.isNotNull(), F.struct(hit["p"].alias("provider"), F.when(hit["base"], "base_model_namespace").otherwise("model_namespace").alias("basis"))).otherwise(
        F.struct(F.concat(F.lit("namespace:"), namespace(model)).alias("provider"), F.lit("unmapped_public_namespace").alias("basis"))
    )


def model_family(model: Column, bases: Column) -> Column:
    empty = F.array().cast("array<string>")
    joined = F.lower(F.concat_ws(" ", F.coalesce(bases, empty), model))
    chosen = F.coalesce(F.try_element_at(bases, F.lit(1)), model)
    name = F.regexp_replace(chosen, r"^[^/]*/", "")
    fallback = F.regexp_extract(name, r"^([^-_]*)", 1)
    return _first([(F.regexp(joined, F.lit(p)), F.lit(n)) for p, n in rules.FAMILIES], F.when(fallback == "", "unresolved").otherwise(fallback))


def package_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(value), r"^([^<>=!~;\s\[]*)", 1)), r"[_.]+", "-")


def requirement_packages(text: Column) -> Column:
    """Sorted packages of a requirements file."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.trim(x), "^\ufeff+", ""))
    kept = F.filter(lines, lambda x: ~F.regexp(x, F.lit(r"^(?:#|-r|--|git\+|http:|https:|$)")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(kept, package_name), lambda p: p != "")))


def json_packages(text: Column, runtime: bool = True) -> Column:
    """Sorted packages of a package.json."""
    keys = ("dependencies",) if runtime else ("devDependencies", "peerDependencies", "optionalDependencies")
    maps = F.from_json(F.regexp_replace(text, "^\ufeff+", ""), ", ".join(f"{k} map<string,string>" for k in keys))
    empty = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.map_keys(maps[k]), empty) for k in keys])
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, package_name), lambda p: p != "")))


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1)


def is_nonruntime_requirements(path: Column) -> Column:
    name = base_name(path)
    parts = F.split(F.regexp_replace(name, r"\.txt$", ""), r"[-_.]+")
    return (name != "requirements.txt") & F.arrays_overlap(parts, _strings(rules.NONRUNTIME_MARKERS))


def is_requirements(path: Column) -> Column:
    return base_name(path).startswith("requirements") & base_name(path).endswith(".txt")


def is_analysis_source(path: Column) -> Column:
    """Not generated, vendored, a checkpoint or a test."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~(F.arrays_overlap(folders, _strings(rules.SKIPPED_FOLDERS)) | F.regexp(base_name(path), F.lit(rules.TEST_FILE)))


def is_code(path: Column) -> Column:
    return suffix(path).isin(*rules.CODE_SUFFIXES) | (base_name(path) == ".env.example")


def plain_executable(path: Column, text: Column) -> Column:
    """Text without comments, for all files but .py (see source_code.executable_text)."""
    text = F.regexp_replace(text, "^\ufeff+", "")
    script = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|<!--.*?-->", " "), r"(?m)(^|[^:])//[^\n]*", "$1 ")
    settings = F.regexp_replace(text, r"(?m)^\s*[#;].*$", "")
    return F.when(suffix(path).isin(".js", ".jsx", ".ts", ".tsx", ".html"), script).when((suffix(path) == ".ini") | (base_name(path) == ".env.example"), settings).otherwise(text)


def credentials(text: Column) -> Column:
    """Sorted credential names that no known provider's signature explains."""
    known = "(?i)" + "|".join(f"(?:{p})" for *_, p in rules.SIGNATURES)
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({rules.CREDENTIAL})"), F.lit(1)), lambda c: ~F.regexp(c, F.lit(known)))))


def is_placeholder_domain(domain: Column) -> Column:
    d = F.regexp_replace(F.lower(domain), r"^[\[\]]+|[\[\]]+$", "")
    return d.isin("localhost", "api.example.com", "::1") | F.regexp(d, F.lit(r"\.example(?:\.com|\.org|\.net)?$|^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$"))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(https?://[a-z0-9.-]+(?::[0-9]+)?(?:/[^\\s\"'`<>)]*)?)"), F.lit(1)))


def api_domains(text: Column) -> Column:
    """Sorted domains of API-like addresses that no known provider's signature explains."""
    known = "(?i)" + "|".join(f"(?:{p})" for *_, p in rules.SIGNATURES)
    found = F.transform(urls(text), lambda u: F.struct(F.lower(F.regexp_extract(u, r"(?i)^https?://([^/:]+)", 1)).alias("d"), u.alias("u")))
    marked = lambda u: reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(m)) for m in rules.API_MARKERS])
    kept = F.filter(found, lambda x: ~is_placeholder_domain(x["d"]) & (x["d"].startswith("api.") | marked(x["u"])) & ~F.regexp(x["u"], F.lit(known)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["d"])))


def repositories(text: Column) -> Column:
    """Distinct owner/repository links, in case-folded order."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?i)https?://github\.com/([a-z0-9_.-]+/[a-z0-9_.-]+)"), F.lit(1))
    clean = F.transform(pairs, lambda x: F.regexp_replace(F.regexp_replace(x, r"\.git$", ""), r"[.,);\]}]+$", ""))
    kept = F.array_distinct(F.filter(clean, lambda x: ~x.endswith("/")))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def model_ids(text: Column) -> Column:
    """Distinct model ids in loading contexts, in case-folded order."""
    loads = F.regexp_extract_all(text, F.lit(r"""(?i)from_pretrained\(\s*[rubf]*["']([\w.-]+/[\w.:-]+)["']"""), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"""(?i)(?:model_id|model_name|repo_id|model)\s*=\s*[rubf]*["']([\w.-]+/[\w.:-]+)["']"""), F.lit(1))
    kept = F.array_distinct(F.concat(loads, names))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def license_name(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    clean = F.regexp_replace(F.translate(F.replace(text, F.lit("license:"), F.lit("")), "_ ", "--"), "-+", "-")
    aliases = F.create_map(*[F.lit(x) for pair in rules.LICENSE_ALIASES.items() for x in pair])
    return F.when(text.isin("", "none", "null", "unknown"), "missing").when(text == "other", "other").otherwise(F.coalesce(F.try_element_at(aliases, clean), clean))


def license_names(values: Column) -> Column:
    """Several licences as one name: sorted, joined by +."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, license_name), lambda x: x != "missing")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(kept, "+")).otherwise("missing")


def license_class(name: Column) -> Column:
    """The strongest class of a normalized name's parts."""

    def one(x: Column) -> Column:
        special = reduce(lambda a, b: a | b, [x.startswith(p) for p in rules.MODEL_SPECIFIC]) | F.contains(x, F.lit("openrail"))
        limited = x.isin(*rules.RESTRICTED) | F.regexp(x, F.lit("-nc|research-only|non-commercial"))
        return F.when(x == "missing", "missing").when(x.isin(*rules.PERMISSIVE), "permissive").when(x.isin(*rules.COPYLEFT), "copyleft").when(limited, "restricted").when(special, "model_specific").otherwise("other")

    classes = F.transform(F.split(name, r"\+"), one)
    return _first([(F.array_contains(classes, c), F.lit(c)) for c in ("restricted", "model_specific", "copyleft", "permissive", "other")], "missing")


def rights_flag(app: Column, upstream: Column) -> Column:
    """A review status of a project's licence class against its upstream classes."""
    free = app.isin("permissive", "copyleft")
    some = lambda *c: F.exists(upstream, lambda x: x.isin(*c))
    return (
        F.when(app == "missing", "app_license_missing")
        .when(F.size(upstream) == 0, "no_observed_model_dependency")
        .when(F.forall(upstream, lambda x: x == "missing"), "upstream_license_unresolved")
        .when(free & some("restricted", "model_specific"), "review_rights_asymmetry")
        .when(free & some("missing", "other"), "review_incomplete_upstream_terms")
        .when(free & F.forall(upstream, lambda x: x.isin("permissive", "copyleft")), "no_automated_flag")
        .otherwise("manual_review")
    )


def license_in_text(text: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return _first([(F.contains(squeezed, F.lit(f)), F.lit(n)) for n, f in rules.FINGERPRINTS], "missing")


def location(value: Column, countries: dict[str, str] | None = None) -> Column:
    """(region, code) of an explicitly named country; cities stay unresolved.  Aliases first, then the longest name."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.coalesce(value, F.lit(""))), "._", "  "), r"[^\pL\pN_ ]+", " "), r"\s+", " "))
    names = sorted((countries or rules.COUNTRIES).items(), key=lambda x: (-len(x[0]), x[0]))
    known = F.array(*[F.struct(F.lit(f" {n} ").alias("n"), F.lit(c).alias("c")) for n, c in (*rules.COUNTRY_ALIASES, *(x for x in names if len(x[0]) >= 4))])
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    code = F.coalesce(F.try_element_at(F.filter(known, lambda x: F.contains(padded, x["n"])), F.lit(1))["c"], F.lit(""))
    region = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "missing").when(code == "", "unresolved").when(code.isin(*rules.ASIA_CODES), "asia").otherwise("outside_asia")
    return F.struct(region.alias("region_class"), F.when(region == "missing", "").otherwise(code).alias("country_code"))


def language_orientation(tags: Column, card: Column) -> Column:
    """(class, codes) of declared content languages."""
    tagged = F.transform(F.filter(F.transform(tags, F.lower), lambda t: t.startswith("language:")), lambda t: F.substring_index(t, ":", -1))
    empty = F.array().cast("array<string>")
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(tagged, F.coalesce(F.transform(card, F.lower), empty)), lambda x: F.split_part(x, F.lit("-"), F.lit(1))), lambda x: x != "")))
    asia = _strings(rules.ASIA_LANGUAGES)
    label = F.when(F.size(codes) == 0, "undeclared").when(F.size(F.array_except(codes, asia)) == 0, "asia_language_only").when(F.arrays_overlap(codes, asia), "includes_asia_language").otherwise("other_declared_language")
    return F.struct(label.alias("language_class"), F.array_join(codes, ";").alias("language_codes"))


def slug(value: Column) -> Column:
    """File-name safe text; a hash where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(kept == "", F.substring(F.sha2(value, 256), 1, 16)).otherwise(kept)


def inclusion(strict: Column, broad: Column, evidence: Column) -> Column:
    """Why a candidate is or isn't in the frame."""
    return F.when(F.size(broad) == 0, "no_education_function_phrase").when(~evidence, "no_model_or_inference_dependency").when(F.size(strict) == 0, "broad_only").otherwise("included_strict")


def compact(value: Column, limit: int = 1200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), 1, limit)


def bibtex_fields(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?i)\b{name}\s*=\s*[{{\"]([^}}\"]*)[}}\"]"), F.lit(1))

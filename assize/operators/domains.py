"""What a project is made of, from its files, and the documentation queries that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that tell a language (fixed values).
LANGUAGE_FILES = {
    "rust": ("Cargo.toml",),
    "python": ("pyproject.toml", "setup.py", "requirements.txt"),
    "typescript": ("tsconfig.json",),
    "go": ("go.mod",),
    "hcl": (".terraform.lock.hcl", "terraform.tfvars"),
}
#: Packages of package.json and words of pyproject.toml that tell a framework (fixed values).
PACKAGES = {"nextjs": "next", "react": "react", "vue": "vue", "express": "express", "fastify": "fastify"}
PYTHON_WORDS = ("fastapi", "django", "flask")
#: Folders and files of which two tell Home Assistant (fixed values).
HOME_FOLDERS = ("custom_components", "blueprints", "packages", "www")
HOME_FILES = ("secrets.yaml", "automations.yaml", "scripts.yaml", "scenes.yaml")

#: Documentation queries by framework (fixed values).
CURATED = {
    "react": "hooks rules component lifecycle common pitfalls",
    "nextjs": "server components data fetching security",
    "django": "ORM security CSRF protection middleware",
    "fastapi": "dependency injection security validation",
    "flask": "request handling security session management",
    "express": "middleware security input validation",
    "vue": "reactivity composition API common pitfalls",
    "fastify": "plugin system validation security hooks",
    "home-assistant": "automations templates blueprints Jinja2 states triggers conditions actions",
    "esphome": "yaml components lambda sensors substitutions",
    "terraform": "provider resource data module security best practices",
}
#: Documentation queries by language (fixed values).
GENERIC = {
    "rust": "common pitfalls async safety error handling",
    "python": "common pitfalls security type safety",
    "typescript": "common pitfalls security type safety async",
    "javascript": "common pitfalls security type safety async",
}
OTHERWISE = "common pitfalls security"
#: Other names of frameworks (fixed values).
SAME = {"next": "nextjs", "next.js": "nextjs"}


def detect(files: DataFrame, project: str = "project") -> DataFrame:
    """``project, languages, frameworks`` (sorted arrays) from ``project, path, text``, paths relative to the project.

    One aggregation of flags; the texts of few named files are looked at. Null
    texts count as empty, a package.json that can't be read names no package.
    """
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    at = lambda *names: path.isin(*names)
    top = lambda ending: path.rlike(rf"^[^/]+\.{ending}$")
    names = F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]))
    esphome = text.startswith("esphome:") | text.contains("\nesphome:")
    seen = {f"is_{lang}": at(*names_) for lang, names_ in LANGUAGE_FILES.items()}
    seen["is_hcl"] = seen["is_hcl"] | top("tf")
    seen |= {"has_package": at("package.json")}
    seen |= {f"fw_{fw}": at("package.json") & F.array_contains(names, name) for fw, name in PACKAGES.items()}
    seen |= {f"fw_{w}": at("pyproject.toml") & F.lower(text).contains(w) for w in PYTHON_WORDS}
    seen["fw_django"] = seen["fw_django"] | (at("manage.py") & text.contains("django"))
    seen["ha_sure"] = at(".HA_VERSION") | (at("configuration.yaml", "configuration/configuration.yaml") & text.rlike(r"(?m)^homeassistant:"))
    seen |= {f"ha_{f}": path.startswith(f"{f}/") for f in HOME_FOLDERS} | {f"ha_{f.removesuffix('.yaml')}": at(f) for f in HOME_FILES}
    seen["fw_esphome"] = (top("yaml") | path.rlike(r"^esphome/[^/]+\.yaml$")) & esphome
    flags = files.groupBy(project).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in seen.items()])

    weak = sum((F.col(n).cast("int") for n in seen if n.startswith("ha_") and n != "ha_sure"), F.lit(0))
    languages = {lang: F.col(f"is_{lang}") for lang in LANGUAGE_FILES} | {"javascript": F.col("has_package") & ~F.col("is_typescript")}
    frameworks = {n[3:]: F.col(n) for n in seen if n.startswith("fw_")}
    frameworks["react"] = F.col("fw_react") & ~F.col("fw_nextjs")
    frameworks |= {"terraform": F.col("is_hcl"), "home-assistant": F.col("ha_sure") | (weak >= 2)}
    listed = lambda found: F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()])))
    return flags.select(project, listed(languages).alias("languages"), listed(frameworks).alias("frameworks"))


def documentation_query(name: Column, language: Column) -> Column:
    """The query for a framework, else for a language, else the common one."""
    of = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(of(CURATED, F.coalesce(of(SAME, name), name)), of(GENERIC, language), F.lit(OTHERWISE))


def code_aware_query(base: Column, imports: Column, most: int = 10) -> Column:
    """The query with the names of up to ``most`` imports behind it; names of one or two bytes are left out.

    An import reads ``name: use ...`` (or from, import), ``@scope/package``, or a dotted path whose last part counts.
    """
    stated = F.regexp_extract_all
    word = lambda i: F.coalesce(
        F.get(stated(i, F.lit(r"^\s*(\S(?:.*?\S)?)\s*: +(?:use|from|import) "), F.lit(1)), 0),
        F.get(stated(i, F.lit(r"^@([^/]*)"), F.lit(1)), 0),
        F.regexp_extract(i, r"([^./:]*)$", 1),
    )
    kept = F.slice(F.filter(F.transform(imports, word), lambda w: F.octet_length(w) > 2), 1, most)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit(" "), F.array_join(kept, " "))).otherwise(base)

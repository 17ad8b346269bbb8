"""Project trees: which files count, their contents and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import listing
from .tree import register

# The file name extensions and ignore lines that results depend on.
SOURCE_EXTENSIONS = (
    ".go", ".ts", ".mts", ".cts", ".tsx", ".js", ".mjs", ".cjs", ".jsx", ".py", ".pyw", ".java",
    ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh", ".cs", ".php", ".module", ".inc",
    ".rb", ".rake", ".rs", ".kt", ".kts", ".scala", ".sc", ".dart",
)
DEFAULT_IGNORES = (
    "node_modules/", "bower_components/", "jspm_packages/", "web_modules/", ".yarn/", ".pnpm-store/",
    ".next/", ".nuxt/", ".svelte-kit/", ".turbo/", ".vite/", ".parcel-cache/", ".angular/", ".docusaurus/", "storybook-static/", ".vinxi/", ".nitro/",
    "out-tsc/", ".vercel/", ".netlify/", ".wrangler/",
    "dist/", "build/", "out/", ".output/",
    "coverage/", ".nyc_output/",
    "__pycache__/", "__pypackages__/", ".venv/", "venv/", ".pixi/", ".pdm-build/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", ".tox/", ".nox/", ".hypothesis/",
    ".ipynb_checkpoints/", ".eggs/",
    "target/", ".gradle/", "obj/", "vendor/",
    ".build/", "Pods/", "Carthage/", "DerivedData/", ".swiftpm/",
    ".dart_tool/", ".pub-cache/", ".cxx/", ".externalNativeBuild/", "vcpkg_installed/", ".bloop/", ".metals/",
    "lua_modules/", ".luarocks/", "__history/", "__recovery/", ".cache/",
    "*.egg-info/", "cmake-build-*/", "bazel-*/",
    "**/res/anim*/", "**/res/animator*/", "**/res/color*/", "**/res/drawable*/", "**/res/font*/", "**/res/layout*/",
    "**/res/menu*/", "**/res/mipmap*/", "**/res/navigation*/", "**/res/transition*/", "**/res/values*/", "**/res/xml*/",
)
#: Folders that are never entered: the version store's and those in which an index lives.
SKIPPED_DIRECTORIES = r"^(\.git|\.symlattice|\.symlattice-.*)$"
LARGEST = 1_048_576


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length, fingerprint) of the source files that no rule ignores, at most 1 MiB each.

    The default rules stand before the root's own; directories that rules ignore are never entered, and only files of the
    right kind and size are opened, by the tasks that read them.
    """
    register(spark)
    found = spark.read.format("pruned_tree").option("rules", "\n".join(DEFAULT_IGNORES)).option("skip", SKIPPED_DIRECTORIES).option("content", "true").load(root)
    source = found.filter(F.col("extension").isin(*SOURCE_EXTENSIONS)).filter(F.col("length") <= LARGEST)
    mark = F.concat_ws(":", F.sha2("content", 256), F.col("modified").cast("string"), F.col("length").cast("string"))
    return source.select("path", "content", "length", mark.alias("fingerprint"))


def list_directory(spark: SparkSession, root: str, part: str = "") -> DataFrame:
    """(name, is_dir, size) of a directory's entries, directories first, optionally only names with ``part`` in any case."""
    register(spark)
    found = spark.read.format("pruned_tree").options(recursive="false", directories="true", gitignore="false").load(root)
    return listing(found.select("name", "is_dir", F.col("length").alias("size")), part)


def module_name(spark: SparkSession, root: str) -> str:
    """What the first ``module`` line of go.mod names; '' without one."""
    try:
        lines = spark.read.text(f"{root}/go.mod")
        found = lines.select(F.regexp_extract(F.trim("value"), "^module (.*)$", 1).alias("m")).filter("m <> ''").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return ""
        raise
    return found["m"].strip() if found else ""

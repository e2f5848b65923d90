"""Commands, their subcommands and file types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import among

# Programs whose first argument is part of the label.
SUBCOMMANDS = ["git", "npm", "pnpm", "yarn", "docker", "cargo", "go", "kubectl", "brew", "pip", "pip3", "vercel", "gh", "expo", "eas", "supabase"]
# Suffixes that are a file type without a path around them.
FILE_EXTS = """py pyi pyx pyc pyo ipynb js mjs cjs jsx ts tsx mts cts json json5 jsonl ndjson html htm xhtml css scss sass less styl svg vue svelte astro
md mdx rst txt text adoc tex bib sh bash zsh fish ps1 psm1 bat cmd awk sed c h cc cpp cxx hpp hh m mm swift kt kts java scala clj cljs cljc
go rs rb erb php pl pm lua r jl dart ex exs erl hs ml mli fs fsx vb cs zig nim cr elm purs res hx sol move wgsl glsl frag vert metal cu asm
sql prisma graphql gql proto thrift avsc yml yaml toml ini cfg conf config env lock plist xml xsd xsl csv tsv parquet avro
png jpg jpeg gif webp bmp ico icns tiff heic avif mp3 mp4 wav ogg flac aac m4a mov avi mkv webm pdf doc docx xls xlsx ppt pptx pages numbers epub
zip tar gz tgz bz2 xz zst rar dmg pkg deb rpm apk ipa aab log out output err diff patch bak tmp swp orig rej snap mk cmake gradle bzl sum mod
tres tscn gd import uid shader maestro example sample dist min map ttf otf woff woff2 eot wasm so dylib dll exe bin obj pdb db sqlite sqlite3""".split()

ASSIGNMENT = r"^[\p{L}\p{Nl}_][\p{L}\p{N}\p{M}_]*="
SUFFIX = r"\.([A-Za-z][A-Za-z0-9]{0,6})$"
_QUOTES = "(){}`'\"$"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def argv_head(cmd: Column) -> Column:
    """The program's name: the first word that sets no variable, without quotes, brackets and directories. Null if nothing is left."""
    first = F.get(F.filter(_words(cmd), lambda w: ~w.rlike(ASSIGNMENT)), F.lit(0))
    return F.nullif(F.element_at(F.split(F.btrim(first, F.lit(_QUOTES)), "/"), -1), F.lit(""))


def subcommand(cmd: Column) -> Column:
    """`git commit` for `git commit -m x`: the first argument that is no option, of programs that have subcommands, if it is a word or has a hyphen and is no path. Null otherwise."""
    head = argv_head(cmd)
    after = F.filter(F.slice(_words(cmd), 2, F.greatest(F.size(_words(cmd)), F.lit(1))), lambda w: ~w.startswith("-"))
    arg = F.btrim(F.get(after, F.lit(0)), F.lit("'\""))
    good = head.isin(SUBCOMMANDS) & ~arg.contains("/") & ~arg.rlike(r"^[.~$]") & (arg.rlike(r"^\p{L}+$") | arg.contains("-"))
    return F.when(good, F.concat(head, F.lit(" "), arg))


def file_extension(text: Column) -> Column:
    """The lower-case suffix of a text's last word, if it is a path or the suffix is a known one, and no address. Null otherwise."""
    word = F.element_at(F.concat(F.array(F.lit("")), _words(text)), -1)
    suffix = F.lower(F.regexp_extract(word, SUFFIX, 1))
    good = (suffix != "") & ~word.contains("://") & (word.rlike(r"[/\\]") | among(suffix, FILE_EXTS))
    return F.when(good, suffix)

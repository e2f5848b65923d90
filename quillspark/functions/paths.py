"""Project labels of directories, as column expressions: a worktree belongs to its repository, whose name is the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that are no project, folders of worktrees, roots of temporary folders.
UNKNOWN, TMP, HOME = "unknown", "tmp", "~"
POOLS = ("worktrees", "workspaces")
TMP_ROOTS = ("/tmp", "/var/tmp", "/var/folders")
OPAQUE = r"(?i)^(?:(?=.*\d)[0-9a-f]{4,}|\d+)$"


def _pool(name: Column) -> Column:
    return F.lower(F.ltrim(name, F.lit("."))).isin(*POOLS)


def _last(parts: Column, test) -> Column:
    """The place, from 0, of the last part that passes; -1 if none does."""
    return F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(test(x), i).otherwise(-1))), F.lit(-1))


def _clean(cwd: Column) -> Column:
    path = F.rtrim(F.btrim(cwd, F.lit(" \t\n\r")), F.lit("/"))
    return F.when(path.startswith("/private/"), F.substring(path, 9, 1 << 30)).otherwise(path)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _named(cwd: Column, f) -> Column:
    """f of the path and its parts, each computed once."""
    return F.transform(F.array(F.struct(_clean(cwd).alias("path"), _parts(_clean(cwd)).alias("parts"))), lambda x: f(x["path"], x["parts"]))[0]


def _is_home(parts: Column, home: str | None) -> Column:
    found = (F.concat_ws("/", parts) == "root") | ((F.size(parts) == 2) & F.get(parts, F.lit(0)).isin("Users", "home"))
    return found | (F.concat_ws("/", parts) == home.strip("/")) if home else found


def _worktree(parts: Column, home: str | None) -> Column:
    """What a worktree's path says: the repository, and the branch where one is named. Null for other paths."""
    at = _last(parts, _pool)
    above = F.slice(parts, F.lit(1), F.greatest(at, F.lit(0)))
    repo = _last(above, lambda x: ~x.startswith("."))
    hidden = F.get(parts, at).startswith(".") | (repo < at - 1)
    inside = hidden & (repo >= 0) & ~_is_home(F.slice(parts, F.lit(1), repo + 1), home)
    below = F.slice(parts, at + 2, F.greatest(F.size(parts), F.lit(1)))
    # a pool in a tool's own folder: the repository is the first part below it that is no id, and a workspace the part below that, if it is the last
    first = F.coalesce(F.array_min(F.filter(F.transform(below, lambda x, i: F.when(x.rlike(OPAQUE), -1).otherwise(i)), lambda i: i >= 0)), F.lit(-1))
    workspace = F.when((F.lower(F.ltrim(F.get(parts, at), F.lit("."))) == "workspaces") & (first >= 0) & (first + 2 == F.size(below)), F.get(below, first + 1))
    out = F.struct(F.when(inside, F.get(parts, repo)).otherwise(F.coalesce(F.get(below, first), F.lit(UNKNOWN))).alias("repo"), F.lower(F.when(inside, F.get(below, F.lit(0))).otherwise(workspace)).alias("branch"))
    return F.when(at >= 0, out)


def project_from_cwd(cwd: Column, home: str | None = None, tmp: Sequence[str] = ()) -> Column:
    """The label of a working directory: the repository of a worktree, `tmp`, `~` for the home folder, else the last part; `unknown` for none."""

    def label(path: Column, parts: Column) -> Column:
        roots = [r.rstrip("/") for r in (*TMP_ROOTS, *tmp)]
        temporary = F.lit(False)
        for r in roots:
            temporary = temporary | (path == r) | path.startswith(f"{r}/")
        own = F.when(temporary, TMP)
        if home:
            own = own.when(path == home.rstrip("/"), HOME)
        return F.coalesce(_worktree(parts, home)["repo"], own.otherwise(F.element_at(F.concat(F.array(F.lit(UNKNOWN)), parts), -1)))

    return F.when(cwd.isNull() | (_clean(cwd) == ""), UNKNOWN).otherwise(_named(cwd, label))


def branch_of_cwd(cwd: Column, home: str | None = None) -> Column:
    """The branch that a worktree's path names, lower-cased; null for other paths."""
    return _named(cwd, lambda path, parts: _worktree(parts, home)["branch"])


def _dashed(label: Column) -> tuple[Column, Column, Column]:
    """Parts of a label between dashes, and the place of the first that is a pool's name (-1: none)."""
    parts = F.split(label, "-")
    at = F.coalesce(F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(_pool(x), i).otherwise(-1)), lambda i: i >= 0)), F.lit(-1))
    return parts, at, F.slice(parts, F.lit(1), F.greatest(at, F.lit(0)))


def normalize_project(label: Column) -> Column:
    """An older label with a worktree's folders in it, cut down to the repository: two dashes are what is left of a hidden folder, and without them a name may hold the word."""
    parts, at, head = _dashed(label)
    gap = F.array_position(head, "")  # from 1; 0: none
    repo = F.array_join(F.filter(F.slice(head, F.lit(1), F.greatest(gap - 1, F.lit(0)).cast("int")), lambda x: x != ""), "-")
    cut = F.when(at == 0, UNKNOWN).when(gap > 0, F.coalesce(F.nullif(repo, F.lit("")), F.lit(UNKNOWN))).when(F.get(head, F.lit(0)).startswith("."), UNKNOWN).otherwise(label)
    return F.when(label.isNull() | (label == ""), UNKNOWN).when(at >= 0, cut).otherwise(label)


def branch_of_label(label: Column) -> Column:
    """The branch that normalize_project() cuts out of an older label, lower-cased; null if it cuts none."""
    parts, at, head = _dashed(label)
    cuts = (at == 0) | (F.array_position(head, "") > 0) | F.get(head, F.lit(0)).startswith(".")
    below = F.filter(F.slice(parts, at + 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x != "")
    return F.when((at >= 0) & cuts, F.nullif(F.lower(F.array_join(below, "-")), F.lit("")))


def decoded_dashes(name: Column) -> Column:
    """A path from a folder's name in which dashes stand for / and . alike: a doubled dash begins a hidden folder, three parts are folders, and of the rest hidden ones and pools stand alone. identities.decode_dash_path() asks the disk instead."""
    parts = F.split(F.regexp_replace(F.btrim(name, F.lit("-")), "-{2,}", "-."), "-")
    head = F.concat_ws("/", F.slice(parts, 1, 3))
    tail = F.concat_ws("-", F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))))
    pool = rf"\.*(?:{'|'.join(POOLS)})"
    tail = F.regexp_replace(tail, rf"(?i)-(?=\.|{pool}(?:-|$))", "/")
    tail = F.regexp_replace(tail, rf"(?i)((?:^|/){pool})-", "$1/")
    return F.when(F.btrim(name, F.lit("-")) == "", UNKNOWN).otherwise(F.concat(F.lit("/"), F.concat_ws("/", head, F.nullif(tail, F.lit("")))))


def project_from_encoded(name: Column, home: str | None = None) -> Column:
    """The label of a folder's name that encodes a working directory, by percent signs or by dashes."""
    cwd = F.when(name.rlike("(?i)%2f"), F.try_url_decode(F.regexp_replace(name, r"\+", "%2B"))).otherwise(decoded_dashes(name))
    return F.when(cwd == UNKNOWN, UNKNOWN).otherwise(project_from_cwd(cwd, home))

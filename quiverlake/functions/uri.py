"""URI columns: normal form, parts, derived type, category, owner and file levels.

URIs look like ``ctx://scope/part/...``; the scheme is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "ctx"

#: Category names that a path segment may state (fixed value).
CATEGORIES = ("patterns", "cases", "profile", "preferences", "entities", "events", "tools", "skills")
#: Directory names that are no space segment below the user and agent scopes (fixed values).
STRUCTURE = {"user": ("memories",), "agent": ("memories", "skills", "instructions", "workspaces")}


def normalize(raw: Column, scheme: str = SCHEME) -> Column:
    """``scheme:/x``, ``/x`` and ``x`` become ``scheme://x``; end slashes go."""
    body = F.regexp_replace(raw, f"^({scheme}:)?/*", "")
    return F.concat(F.lit(f"{scheme}://"), F.regexp_replace(body, "/+$", ""))


def parts(uri: Column, scheme: str = SCHEME) -> Column:
    """Non-empty path segments, the scope first."""
    return F.filter(F.split(F.regexp_replace(uri, f"^{scheme}://", ""), "/"), lambda p: p != "")


def is_valid(uri: Column, scheme: str = SCHEME) -> Column:
    """Has the scheme and a scope, and no ``.``, ``..`` or backslash segment."""
    bad = F.exists(parts(uri, scheme), lambda p: p.isin(".", "..") | p.contains("\\"))
    return F.startswith(uri, F.lit(f"{scheme}://")) & (F.size(parts(uri, scheme)) > 0) & ~bad


def scope(uri: Column, scheme: str = SCHEME) -> Column:
    return F.coalesce(F.try_element_at(parts(uri, scheme), F.lit(1)), F.lit(""))


def name(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def parent(uri: Column, scheme: str = SCHEME) -> Column:
    """The URI without its last segment; empty for one segment."""
    p = parts(uri, scheme)
    return F.when(F.size(p) <= 1, "").otherwise(F.concat(F.lit(f"{scheme}://"), F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")))


def depth(uri: Column, scheme: str = SCHEME) -> Column:
    return F.size(parts(uri, scheme))


def space(uri: Column, scheme: str = SCHEME) -> Column:
    """Second segment where the scope is owned: user and agent (apart from structure names) and session."""
    p, sc = parts(uri, scheme), scope(uri, scheme)
    second = F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))
    meta = (F.size(p) == 2) & second.isin(".abstract.md", ".overview.md")
    own = (sc == "session") | ((sc == "user") & ~second.isin(*STRUCTURE["user"])) | ((sc == "agent") & ~second.isin(*STRUCTURE["agent"]))
    return F.when(own & ~meta, second).otherwise("")


def row_type(uri: Column, scheme: str = SCHEME) -> Column:
    """Type of a row: from the first segment that names skills, memories or resources."""
    kind = lambda p: F.when(p.contains("skills"), "skill").when(p.contains("memories"), "memory").when(p.contains("resources"), "resource")
    return F.coalesce(F.try_element_at(F.filter(F.transform(parts(uri, scheme), kind), lambda k: k.isNotNull()), F.lit(1)), F.lit(""))


def query_type(uri: Column) -> Column:
    """Type of a query target: memories before skills before resources, anywhere in the URI."""
    return F.when(uri.contains("memories"), "memory").when(uri.contains("skills"), "skill").when(uri.contains("resources"), "resource").otherwise("")


def category(uri: Column, scheme: str = SCHEME) -> Column:
    return F.coalesce(F.try_element_at(F.filter(parts(uri, scheme), lambda p: p.isin(*CATEGORIES)), F.lit(1)), F.lit(""))


def owner_space(uri: Column, user_space: Column, agent_space: Column, scheme: str = SCHEME) -> Column:
    sc = scope(uri, scheme)
    return F.when(sc == "agent", agent_space).when(sc.isin("user", "session"), user_space).otherwise("")


def archive(uri: Column) -> Column:
    """Put ``_archive`` behind the first ``memories`` segment that something follows; else append it.

    Unlike the plain insertion, an archived URI stays as it is.
    """
    return F.when(uri.contains("/_archive"), uri).when(uri.rlike("/memories/"), F.regexp_replace(uri, "^(.*?/memories)/", "$1/_archive/")).otherwise(F.concat(uri, F.lit("/_archive")))


def restore(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(.*?)/memories/_archive/", "$1/memories/")


def with_level(uri: Column, level: Column) -> Column:
    """URI of the level's file: abstracts and overviews are files of their directory."""
    add = lambda suffix: F.when(F.endswith(uri, F.lit(suffix)), uri).otherwise(F.concat(F.regexp_replace(uri, "/+$", ""), F.lit(suffix)))
    return F.when(level == 0, add("/.abstract.md")).when(level == 1, add("/.overview.md")).otherwise(uri)


def shorten(component: Column, most: int = 255) -> Column:
    """A component of over ``most`` bytes keeps a head and gets 8 digits of its hash."""
    room = most - 9
    head = F.make_valid_utf8(F.substring(F.encode(component, "UTF-8"), 1, room).cast("string"))
    short = F.concat(head, F.lit("_"), F.substring(F.sha2(component, 256), 1, 8))
    return F.when(F.octet_length(component) > most, short).otherwise(component)


def sanitize(text: Column, most: int = 80) -> Column:
    """Letters, digits, ``.``, ``_`` and ``-`` stay; runs of others become ``_``."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, most)


def sanitize_segment(text: Column) -> Column:
    """One path segment: spaces and slashes become ``_``, other signs of any script stay; empty is ``unnamed``."""
    flat = F.translate(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), " /\\\0", "____")
    return F.when(flat == "", "unnamed").otherwise(flat)


def sanitize_name(text: Column) -> Column:
    """A tool's name: lower case; each sign but a-z, 0-9, ``-`` and ``_`` becomes ``_``."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "_")


def sanitize_file(text: Column, most: int = 100) -> Column:
    """A file name: slashes and colons become ``_``, spaces ``-``; cut to ``most`` bytes."""
    flat = F.translate(text, "/\\: ", "___-")
    return F.when(F.octet_length(flat) > most, F.make_valid_utf8(F.substring(F.encode(flat, "UTF-8"), 1, most).cast("string"))).otherwise(flat)


def sanitize_plain(text: Column) -> Column:
    """Letters and digits of ASCII, ``-`` and ``_`` stay; each other sign becomes ``_``."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


#: Categories that the user's and the agent's memories keep (fixed values).
USER_CATEGORIES = ("preferences", "entities", "events")
AGENT_CATEGORIES = ("cases", "patterns", "tools", "skills")


def category_prefix(category: Column, user_space: Column, agent_space: Column, scheme: str = SCHEME) -> Column:
    """Where memories of a category lie; empty for those that aren't searched."""
    place = lambda who, space: F.concat(F.lit(f"{scheme}://{who}/"), space, F.lit("/memories/"), category, F.lit("/"))
    return F.when(category.isin(*USER_CATEGORIES), place("user", user_space)).when(category.isin(*AGENT_CATEGORIES), place("agent", agent_space)).otherwise("")


def root_uris(context_type: Column, role: Column, user_space: Column, agent_space: Column, scheme: str = SCHEME) -> Column:
    """Array of the roots at which a search begins, by type; root users begin anywhere (an empty array)."""
    at = lambda who, space, what: F.concat(F.lit(f"{scheme}://{who}/"), space, F.lit(f"/{what}"))
    memories = [at("user", user_space, "memories"), at("agent", agent_space, "memories")]
    resources, skills = F.lit(f"{scheme}://resources"), at("agent", agent_space, "skills")
    none = F.array().cast("array<string>")
    by_type = F.when(context_type == "memory", F.array(*memories)).when(context_type == "resource", F.array(resources)).when(context_type == "skill", F.array(skills))
    return F.when(role == "root", none).otherwise(F.coalesce(by_type, F.array(*memories, resources, skills)))


def accessible(uri: Column, role: Column, user_space: Column, agent_space: Column, scheme: str = SCHEME) -> Column:
    """Whether the caller may see the URI."""
    sc, own = scope(uri, scheme), space(uri, scheme)
    by_space = (
        F.when(sc.isin("resources", "temp"), True)
        .when(sc == "_system", False)
        .when(sc.isin("user", "session") & (own != ""), own == user_space)
        .when((sc == "agent") & (own != ""), own == agent_space)
        .otherwise(True)
    )
    return F.when(role == "root", True).otherwise(by_space)


def source_kind(url: Column) -> Column:
    """git, url or local."""
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    web = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    hub = host.isin("github.com", "gitlab.com", "www.github.com", "www.gitlab.com")
    repo = (F.size(path) == 2) | ((F.size(path) == 4) & (F.try_element_at(path, F.lit(3)) == "tree"))
    git = url.rlike("^git@[^:]+:.+$") | F.startswith(url, F.lit("ssh://")) | F.startswith(url, F.lit("git://")) | F.coalesce(web & hub & repo, F.lit(False))
    return F.when(git, "git").when(web, "url").otherwise("local")


def url_file(url: Column) -> Column:
    """Last path segment of a URL without query and fragment; the host if there is none."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")
    return F.substring_index(F.regexp_replace(bare, "/+$", ""), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1))

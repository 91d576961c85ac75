"""Column expressions over URLs and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import unescaped

#: Second-last labels of a host that make the site three labels long. Fixed values.
SHARED_LABELS = ("org", "co", "ac", "gov", "nhs")
DOCUMENTS = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|jpe?g|png|gif|mp4|mp3)$"


def host(url: Column) -> Column:
    """Lower-case host without user, port and leading www; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def site(url: Column) -> Column:
    """The registrable part of a URL's host: two labels, or three under a shared second label."""
    labels = F.split(host(url), r"\.")
    n = F.when(F.element_at(labels, F.when(F.size(labels) >= 2, -2).otherwise(-1)).isin(*SHARED_LABELS), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")


def same_site(a: Column, b: Column) -> Column:
    return (site(a) != "") & (site(a) == site(b))


def is_subdomain(inner: Column, outer: Column) -> Column:
    """Whether a host is another or below it."""
    return (inner == outer) | inner.endswith(F.concat(F.lit("."), outer))


def hrefs(html: Column) -> Column:
    """The values of href attributes in page order, in quotes of either kind or in none."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda h: F.when(h.rlike("^[\"']"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h))


def absolute(base: Column, link: Column) -> Column:
    """A link resolved against its page (rooted paths and full URLs), without its fragment."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    full = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, F.lit("/"), link))
    return F.regexp_replace(full, r"#.*$", "")


#: What the hosts of volunteer platforms hold.
PLATFORMS = r"(?i)goassemble|rosterfy|betterimpact|simplyvolunteer|teamkinetic|volunteerplus|volunteer|volunteering|do-it\.org|assemblevolunteering"


def platform_hosts(html: Column, url: Column) -> Column:
    """The sorted distinct hosts of volunteer platforms that a page links to, but its own."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    found = F.transform(links, lambda h: host(absolute(url, h)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda h: (h != "") & (h != host(url)) & h.rlike(PLATFORMS))))


def unread_hosts(hosts: Column, covered: Column) -> Column:
    """Hosts that no covered host is or is above."""
    return F.filter(hosts, lambda h: ~F.exists(covered, lambda c: is_subdomain(h, c)))


def known_pages(links: Column, landing: Column) -> Column:
    """Pages to read again: http links without fragments and slashes at their ends, not the landing page, no documents, once
    each in order."""
    trim = lambda x: F.rtrim(x, F.lit("/"))
    bare = F.transform(F.array_compact(links), lambda x: trim(F.regexp_replace(x, r"(?s)#.*$", "")))
    return F.array_distinct(F.filter(bare, lambda x: x.rlike("^https?://") & ~x.rlike(DOCUMENTS) & (x != trim(landing))))


#: Fixed value: how a page states its last change.
UPDATED = r"(?i)(?:last\s+)?updated[:\s]*(\d{1,2}(?:st|nd|rd|th)?\s+\w+,?\s+\d{4}|\d{4}-\d{2}-\d{2})"


def updated_date(text: Column) -> Column:
    """The date, as written, after "updated" within the first 20,000 characters of a page's text."""
    found = F.regexp_extract(F.substring(text, 1, 20_000), UPDATED, 1)
    return F.when(found != "", F.trim(found))


def looks_client_rendered(html: Column, prose_length: Column) -> Column:
    """Whether a page is a script's shell: a framework's mark, or hardly any prose beside a script."""
    mark = html.rlike(r'(?i)id="(?:root|app|__next|__nuxt)"\s*>\s*</div>|data-reactroot|ng-version=')
    return mark | ((prose_length < 80) & html.rlike("(?i)<script"))


def image_kind(content: Column) -> Column:
    """png, jpg, webp or svg by a file's first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    # Each byte as a character, as the bytes may be no text.
    text = F.lower(F.decode(F.substring(content, 1, 4000), "ISO-8859-1"))
    svg = F.substring(text, 1, 2000).rlike(r"^[\t\n\x0b\f\r ]*<(?:svg|\?xml)") & text.contains("<svg")
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(svg, "svg")


def html_to_text(html: Column) -> Column:
    """Line ends for breaks and blocks, other tags as blanks, all character references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(?:p|li|h[1-6]|div)>", "\n")
    x = unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    x = F.regexp_replace(F.regexp_replace(x, "[ \t\u00a0]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{2,}", "\n"))


def content_hash(sections: Column) -> Column:
    """A digest of a page's sections whatever their order."""
    return F.sha2(F.array_join(F.sort_array(sections), "\n\n"), 256)

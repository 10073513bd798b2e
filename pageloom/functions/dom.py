"""Page parts as native expressions over the ``nodes`` array of a page.

The expressions are SQL lambdas over one column, built as text: a page document
has some hundred nested lambdas, and text reaches the JVM in one call. Fragments
(names with ``_``) are SQL strings; lambda variables are named so that no fragment
hides a variable of the lambda around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.text import WHITESPACE

# Fixed values.
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NEXT_WORDS = "(?i)next|continue|forward"
PREVIOUS_WORDS = "(?i)previous|back|prev"
MIN_PARAGRAPH_CHARS = 10
# Characters of element texts in one row, about.
RUN_CHARS = 1_000_000

_NO_STRINGS = "cast(array() AS array<string>)"


def _bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _strip(value: str) -> str:
    return f"trim(BOTH '{WHITESPACE}' FROM {value})"


def _tagged(nodes: str, *tags: str) -> str:
    names = ", ".join(f"'{t}'" for t in tags)
    return f"filter({nodes}, n -> n.tag IN ({names}))"


def _first(array: str) -> str:
    return f"get({array}, 0)"


def _each_inside(element: str, body: str) -> str:
    """``body`` for every place ``j`` of an element's descendants, in document order.

    Taken by position: ``slice`` inside a lambda goes through the whole array, so that a page would cost the
    square of its nodes.
    """
    places = f"sequence({element}.pos + 1, {element}.last)"
    none = f"CASE WHEN {element}.pos IS NOT NULL THEN cast(array() AS array<int>) END"
    return f"transform(CASE WHEN {element}.last > {element}.pos THEN {places} ELSE {none} END, j -> {body})"


def _inside(element: str) -> str:
    """Descendants of an element, in document order."""
    return _each_inside(element, "get(nodes, j)")


def _attr(element: str, name: str) -> str:
    return f"coalesce({element}.attrs['{name}'], '')"


def _classes(element: str) -> str:
    return f"split({_strip(_attr(element, 'class'))}, '[{WHITESPACE}]+')"


def _string(node: str) -> str:
    """The stripped string of a text node; null for any other, as ``array_join`` leaves nulls out.

    The tokenizer has counted the characters that are left, so most strings are taken as they are.
    """
    whole = f"CASE WHEN {node}.chars = length({node}.text) THEN {node}.text ELSE {_strip(f'{node}.text')} END"
    return f"CASE WHEN {node}.tag = '#text' THEN {whole} END"


def _text(element: str) -> str:
    """Stripped strings of an element joined without a separator."""
    return f"array_join({_each_inside(element, _string('get(nodes, j)'))}, '')"


def _text_or_empty(element: str) -> str:
    return f"CASE WHEN {element} IS NULL THEN '' ELSE {_text(element)} END"


def _raw(nodes: str) -> str:
    return f"array_join(transform({_tagged(nodes, '#text')}, n -> n.text), '')"


def _only_string(element: str) -> str:
    """The string of an element whose descendants form one chain ending in text."""
    end = f"get(nodes, {element}.last)"
    chain = f"{end}.depth - {element}.depth = {element}.last - {element}.pos"
    return f"CASE WHEN {element}.last > {element}.pos AND {chain} THEN {end}.text END"


def raw_text() -> Column:
    return F.expr(_raw("nodes"))


def clean_text() -> Column:
    strings = f"transform(nodes, n -> {_string('n')})"
    return F.expr(f"array_join(filter({strings}, s -> s <> ''), ' ')")


def title() -> Column:
    text = f"coalesce({_strip(_only_string('e'))}, {_text('e')})"
    found = _first(_tagged("nodes", "title"))
    return F.expr(_bind(found, "e", f"CASE WHEN e IS NULL THEN '' ELSE {text} END"))


def headings() -> Column:
    anchor = f"CASE WHEN {_attr('h', 'id')} = '' THEN '' ELSE concat('#', {_attr('h', 'id')}) END"
    return F.expr(
        f"""transform({_tagged('nodes', *HEADING_TAGS)}, h -> struct(
            h.tag AS level, {_text('h')} AS text, {_attr('h', 'id')} AS id, {anchor} AS anchor))"""
    )


def _paragraphs() -> str:
    return f"filter(nodes, n -> n.tag = 'p' AND n.chars > {MIN_PARAGRAPH_CHARS})"


def paragraphs() -> Column:
    return F.expr(f"transform({_paragraphs()}, p -> {_text('p')})")


def paragraph_runs() -> Column:
    """Paragraphs in runs of (first, how many) whose texts are short together, or of one.

    Unclosed paragraphs hold all that follow them, so the texts of a page may add up to the square of its size;
    a run at a time they never lie in one row.
    """
    longest = "array_max(transform(ps, p -> p.chars))"
    run = f"greatest(1, cast({RUN_CHARS} / {longest} AS int))"
    starts = f"CASE WHEN size(ps) > 0 THEN sequence(0, size(ps) - 1, {run}) ELSE cast(array() AS array<int>) END"
    return F.expr(_bind(_paragraphs(), "ps", f"transform({starts}, s -> struct(s AS first, {run} AS run))"))


def paragraph_run(first: str, run: str) -> Column:
    """The texts of one run."""
    return F.expr(f"transform(slice({_paragraphs()}, {first} + 1, {run}), p -> {_text('p')})")


def code_blocks() -> Column:
    marked = _first(f"filter({_classes('b')}, c -> c RLIKE '^lang(uage)?-')")
    return F.expr(
        f"""transform({_tagged('nodes', 'code', 'pre')}, b -> struct(
            coalesce(regexp_replace({marked}, '^lang(uage)?-', ''), '') AS language,
            {_raw(_inside('b'))} AS content,
            {_attr('b', 'data-filename')} AS file_name))"""
    )


def _caption(img: str) -> str:
    """Caption of the nearest figure around an image, else a caption right after it.

    The tokenizer has noted where both are, so an image costs its own caption only.
    """
    figcaption, sibling = f"get(nodes, {img}.figcaption)", f"get(nodes, {img}.beside)"
    from_figure = _bind(figcaption, "c", f"CASE WHEN c IS NOT NULL THEN {_text('c')} END")
    is_caption = f"array_contains({_classes('c')}, 'caption')"
    from_sibling = _bind(sibling, "c", f"CASE WHEN {is_caption} THEN {_text('c')} END")
    return f"coalesce({from_figure}, {from_sibling}, '')"


def images() -> Column:
    with_src = f"filter({_tagged('nodes', 'img')}, i -> {_attr('i', 'src')} <> '')"
    return F.expr(
        f"""transform({with_src}, i -> struct(
            coalesce(i.url, {_attr('i', 'src')}) AS src,
            {_attr('i', 'alt')} AS alt,
            {_attr('i', 'title')} AS title,
            {_caption('i')} AS caption,
            '' AS local_path))"""
    )


def links(page_url: str = "url") -> Column:
    with_href = f"filter({_tagged('nodes', 'a')}, a -> a.attrs['href'] IS NOT NULL)"
    found = f"""transform({with_href}, a -> struct(
        coalesce(a.url, a.attrs['href']) AS href,
        {_text('a')} AS text,
        {_attr('a', 'title')} AS title))"""
    return F.transform(
        F.expr(f"filter({found}, a -> a.text <> '')"),
        lambda a: F.struct(
            a["href"].alias("href"),
            a["text"].alias("text"),
            a["title"].alias("title"),
            urls.link_type(a["href"], F.col(page_url)).alias("type"),
            F.lit("pending").alias("status"),
        ),
    )


def tables() -> Column:
    """Header, rows and caption of every table that has data.

    Rows of a ``thead`` are headers and rows; a first row of ``th`` only is just
    the header. A table without rows has null rows and is dropped by the filter.
    """

    def cells(row: str) -> str:
        return f"transform({_tagged(_inside(row), 'th', 'td')}, d -> {_text('d')})"

    top = _tagged(_inside("get(rows, 0)"), "th", "td")
    only_th = f"(head IS NULL AND forall({top}, d -> d.tag = 'th'))"
    data = f"CASE WHEN {only_th} THEN slice(rows, 2, size(rows)) ELSE rows END"
    caption = _bind(_first(_tagged("body", "caption")), "c", _text_or_empty("c"))
    shape = f"""struct(
        CASE WHEN head IS NOT NULL THEN {cells('head')} WHEN {only_th} THEN {cells('get(rows, 0)')}
             ELSE {_NO_STRINGS} END AS headers,
        filter(transform({data}, r -> {cells('r')}), r -> size(r) > 0) AS rows,
        {caption} AS caption)"""
    shape = _bind(_tagged("body", "tr"), "rows", shape)
    shape = _bind(_first(_tagged("body", "thead")), "head", shape)
    shape = _bind(_inside("e"), "body", shape)
    return F.expr(
        f"filter(transform({_tagged('nodes', 'table')}, e -> {shape}), e -> size(e.rows) > 0)"
    )


def lists() -> Column:
    items = f"transform({_tagged(_inside('l'), 'li')}, i -> {_text('i')})"
    found = f"""transform({_tagged('nodes', 'ul', 'ol')}, l -> struct(
        CASE l.tag WHEN 'ol' THEN 'ordered' ELSE 'unordered' END AS type, {items} AS items))"""
    return F.expr(f"filter({found}, l -> size(l.items) > 0)")


def breadcrumb() -> Column:
    """Labels of the first match of five selectors, tried in this order.

    Nodes that no selector can match go first, so classes are split for few of them.
    """
    named = f"contains({_attr('b', 'class')}, 'breadcrumb')"
    marked = f"filter(nodes, b -> {named} OR b.attrs['aria-label'] = 'breadcrumb' OR b.attrs['id'] = 'breadcrumb')"

    def with_class(name: str) -> str:
        return _first(f"filter(marks, b -> array_contains({_classes('b')}, '{name}'))")

    def with_value(key: str) -> str:
        return _first(f"filter(marks, b -> b.attrs['{key}'] = 'breadcrumb')")

    trail = ", ".join(
        (
            with_class("breadcrumb"),
            with_class("breadcrumbs"),
            with_value("aria-label"),
            with_class("nav-breadcrumb"),
            with_value("id"),
        )
    )
    labels = f"transform({_tagged(_inside('e'), 'a', 'span')}, a -> {_text('a')})"
    kept = f"coalesce(filter({labels}, s -> s <> ''), {_NO_STRINGS})"
    return F.expr(_bind(_bind(marked, "marks", f"coalesce({trail})"), "e", kept))


def step_link(words: str) -> Column:
    """Target of the first link whose only string matches ``words``."""
    found = f"filter({_tagged('nodes', 'a')}, a -> {_only_string('a')} RLIKE '{words}')"
    resolved = "coalesce(a.url, a.attrs['href'])"
    target = f"CASE WHEN {_attr('a', 'href')} = '' THEN '' ELSE {resolved} END"
    return F.expr(_bind(_first(found), "a", target))


def _meta(key: str, value: str) -> str:
    return _first(f"filter({_tagged('nodes', 'meta')}, m -> m.attrs['{key}'] = '{value}')")


def _content(key: str, value: str) -> str:
    return _bind(_meta(key, value), "m", _attr("m", "content"))


def seo() -> Column:
    keywords = f"transform(split({_attr('m', 'content')}, ','), k -> {_strip('k')})"
    keywords = f"CASE WHEN m IS NULL THEN {_NO_STRINGS} ELSE {keywords} END"
    is_canonical = f"array_contains(split({_attr('l', 'rel')}, '[{WHITESPACE}]+'), 'canonical')"
    canonical = _first(f"filter({_tagged('nodes', 'link')}, l -> {is_canonical})")
    # A bare struct: Spark then leaves out the fields that nobody reads.
    return F.expr(
        f"""struct(
            {_content('name', 'description')} AS meta_description,
            {_bind(_meta('name', 'keywords'), 'm', keywords)} AS meta_keywords,
            {_content('property', 'og:title')} AS og_title,
            {_content('property', 'og:description')} AS og_description,
            {_content('property', 'og:image')} AS og_image,
            {_bind(canonical, 'l', _attr('l', 'href'))} AS canonical_url)"""
    )


def has_element(tag: str) -> Column:
    return F.expr(f"exists(nodes, n -> n.tag = '{tag}')")


def has_description() -> Column:
    return F.expr(f"{_meta('name', 'description')} IS NOT NULL")


def all_images_have_alt() -> Column:
    return F.expr(f"forall({_tagged('nodes', 'img')}, i -> {_attr('i', 'alt')} <> '')")

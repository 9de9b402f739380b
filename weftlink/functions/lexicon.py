"""Word lists, tables and patterns that decide results."""

from __future__ import annotations

# Fixed values from here to the end of the file: they decide which words, elements and addresses count.

#: Words that never become keywords. Words of up to three letters are dropped by length, so none is listed.
STOPWORDS = tuple(
    """
    with from were been being have does will would could should might must this that these those both either neither
    each more most other some such than very just about above after before between into through during without within
    along across behind beyond plus except around down near also what which when where then there here they them your
    their used using make made need help want know come many much every even still often always never three time work
    team data tool platform solution find provide build include based important different specific real multiple
    various given well large small high first last next right left long short while since like only same over under
    back global world page site website click read learn able allows helps makes number type types part parts whether
    below though although however therefore furthermore moreover nevertheless consequently accordingly
    """.split()
)

#: Words too vague for an anchor of one word.
GENERIC_WORDS = tuple(
    """
    learn read click here visit check find get see view more link page post article blog guide resource download
    explore discover understand use know help
    analysis insights insight strategy strategies market trends trend data information info content overview
    introduction summary report research study work approach solution platform tool tools software system process
    service services product products technology technologies framework method methodology best practices tips advice
    example examples case results outcome impact value benefits features details topic topics area field industry
    sector domain space landscape ecosystem
    important key critical essential major significant relevant related similar various different new latest recent
    current future next previous many other
    business company companies organization organizations enterprise team teams people users customers clients partners
    vendors stakeholders
    today now year years month months quarter week time level type types kind way ways
    """.split()
)

#: A word of an anchor alone is generic if it matches one of these.
GENERIC_WORD_PATTERNS = (r"^[0-9]+$", r"^[a-z]{1,3}$")

#: Link texts that say nothing about their target.
GENERIC_ANCHORS = (
    "click here", "here", "read more", "learn more", "find out more", "discover more", "see more", "this",
    "this article", "this post", "this page", "more", "more info", "more information", "visit", "visit page", "view",
    "view page", "link", "source", "article", "post", "page", "website", "site",
)

#: Where a page's main text may be, in the order in which it is looked for: selector, name, confidence.
ZONES = (
    ('[role="main"]', "aria-main", 0.95),
    ("main", "html5-main", 0.93),
    ("article", "html5-article", 0.88),
    (".post-content", "cms-post-content", 0.87),
    (".entry-content", "cms-entry-content", 0.87),
    (".article-content", "cms-article-content", 0.86),
    (".article-body", "cms-article-body", 0.85),
    (".blog-content", "cms-blog-content", 0.84),
    (".blog-post-content", "cms-blog-post", 0.84),
    (".post-body", "cms-post-body", 0.82),
    (".content-body", "cms-content-body", 0.82),
    (".page-content", "cms-page-content", 0.78),
    (".main-content", "cms-main-content", 0.78),
    (".single-content", "cms-single", 0.76),
    (".gh-content", "ghost-content", 0.87),
    (".prose", "prose", 0.75),
    ("#post-content", "id-post-content", 0.85),
    ("#main-content", "id-main-content", 0.80),
    ("#content", "id-content", 0.68),
    ("#main", "id-main", 0.65),
    (".blog-detail", "cms-blog-detail", 0.80),
    (".blog-details", "cms-blog-details", 0.80),
    (".post-entry", "cms-post-entry", 0.78),
    (".entry", "cms-entry", 0.72),
    (".content", "cms-content", 0.65),
    ("#primary", "id-primary", 0.65),
    (".elementor-widget-container", "elementor", 0.70),
    (".td-post-content", "td-post-content", 0.82),
    (".the-content", "the-content", 0.78),
    (".content-area", "content-area", 0.68),
    (".wp-block-post-content", "wp-block-post", 0.85),
    ("body", "density-detected-body", 0.45),
)
#: The zone where none of these has enough words.
LAST_ZONE = ("body", "density-detected-body", 0.35)

NOISE_TAGS = ("script", "style", "noscript", "iframe", "canvas", "svg", "video", "audio", "object", "embed", "picture", "nav", "footer", "header", "aside")
NOISE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog")
INNER_NOISE = ("figure > figcaption", "[data-nosnippet]", '[aria-hidden="true"]', ".wp-caption-text", ".screen-reader-text")

#: An element goes if its class, id or label contains one of these.
BOILERPLATE_PARTS = tuple(
    """
    author-bio author-box author-card author-info author-profile author-section author-block author-widget author-area
    author-details author-meta author-name post-author article-author entry-author about-author written-by
    contributor-box byline bio-box guest-author author-description author-content author-wrap author-panel about-writer
    writer-bio expert-bio contributor-info staff-bio team-member-bio
    site-nav main-nav top-nav primary-nav secondary-nav mega-menu dropdown-menu nav-menu nav-bar navbar breadcrumb
    breadcrumbs crumb-nav
    site-header page-header header-wrap top-bar header-area header-inner site-footer page-footer footer-wrap
    footer-widgets footer-nav footer-area footer-inner bottom-bar
    sidebar side-bar widget-area widget-sidebar right-sidebar left-sidebar sticky-sidebar
    related-posts related-articles related-content related-entries related-reads related-resources recommended-posts
    recommended-articles you-might-like also-like similar-posts more-from more-stories more-like-this whats-next
    further-reading keep-reading next-article prev-article popular-posts trending-posts dont-miss see-also read-next
    up-next
    comment-section comment-area comment-list comment-form comments-wrap comment-meta comment-author comment-reply
    disqus discussion-board comment-thread
    social-share share-buttons share-icons sharing-section social-links follow-buttons follow-us share-bar
    social-media-links social-proof
    newsletter-form newsletter-block newsletter-signup subscribe-form subscription-box subscribe-box cta-block
    cta-section call-to-action promo-box promotional-block lead-gen lead-form conversion-box inline-cta content-upgrade
    opt-in
    popup modal overlay cookie-banner cookie-consent gdpr-notice notice-bar announcement-bar sticky-banner floating-bar
    exit-intent
    advertisement ad-unit ad-slot ad-container google-ad adsense dfp-ad sponsored-content sponsored-post native-ad
    partner-content
    table-of-contents toc-nav sticky-toc toc-sidebar in-page-nav jump-links content-nav article-toc
    post-meta post-tags article-tags entry-meta article-meta post-footer article-footer entry-footer post-date
    post-category post-info article-info entry-info
    testimonial-section testimonials-wrap review-section customer-reviews rating-section
    resource-cards resource-grid product-cards case-study-grid feature-grid card-deck card-grid content-grid
    pagination post-pagination article-pagination pager page-links
    wp-widget text-widget widget-wrap
    """.split()
)
#: An element goes if one of these is a whole word there.
BOILERPLATE_WORDS = tuple(
    """
    author bio byline footer header nav navigation sidebar aside widget related comments comment share social newsletter
    subscribe cta advertisement ads ad pagination breadcrumb toc testimonials testimonial popup modal banner
    """.split()
)

#: Headings whose section is not the page's own text. No case.
BOILERPLATE_HEADINGS = (
    r"^about (the |our |this |an? )?authors?",
    r"^meet (the |our )?authors?",
    r"^about (the )?writer",
    r"^about (the )?contributor",
    r"^author (bio|profile|info(rmation)?|details?)",
    r"^(written|posted|contributed|authored|created|published) by\b",
    r"^contributor (profile|bio|info)",
    r"^guest (author|writer|post)",
    r"^related (posts?|articles?|content|reads?|stories|links?)",
    r"^you might (also )?(like|enjoy|want to read|be interested)",
    r"^(also|further|continue|keep) reading",
    r"^more (from|like this|stories|articles|posts|reads?)",
    r"^recommended (for you|posts?|articles?|reads?|content|resources?)",
    r"^what('s| to) read next",
    r"^read next",
    r"^up next",
    r"^next (up|in (the )?series|article|post)",
    r"^don'?t miss",
    r"^trending (now|topics?|posts?|articles?)?",
    r"^popular (posts?|articles?|reads?)?",
    r"^most (read|popular|viewed|shared)",
    r"^subscribe (now|today|to (our|the|this))",
    r"^sign up (for|to|now)",
    r"^newsletter",
    r"^(leave )?(a )?comments?$",
    r"^join (the )?discussion",
    r"^(share|spread) (this|the|our)",
    r"^tags?:?\s*$",
    r"^categories?:?\s*$",
    r"^filed under:?\s*$",
    r"^topics?:?\s*$",
    r"^(post |entry )?navigation",
    r"^(previous|next) (post|article|entry)",
)
#: The one pattern of paragraphs that heeds case.
BYLINE = r"^by [A-Z][a-zA-ZÀ-ÖØ-ö'-]+ [A-Z]"
#: Paragraphs that are not the page's own text. No case.
BOILERPLATE_TEXTS = (
    r"^about (the |our |this |an? )?authors?",
    r"^written by\b",
    r"^posted by\b",
    r"\bis (a|an) [\w\s-]{0,30}?(writer|editor|journalist|reporter|contributor|blogger|specialist|expert|analyst|strategist|marketer|consultant|manager|director|researcher|author)\b",
    r"\bcovers?\s+[\w\s,]+\s+(for|at|with|in)\s+[A-Z]",
    r"\bwrites?\s+about\s+\w",
    r"\breports?\s+on\s+\w",
    r"\bfocuses?\s+on\s+\w",
    r"\bspecializ(es?|ing)\s+in\b",
    r"\bhas been (writing|covering|reporting|working|creating|contributing) (for|with|at|in|about|since)\b",
    r"\b\d+\+?\s+years? of experience\b",
    r"\bpreviously (worked|wrote|reported|covered|served|contributed)\b",
    r"\b(his|her|their) (work|articles?|writing|content|pieces?) (has|have) (appeared|been published|been featured)\b",
    r"\bfollow (him|her|them|us|@\w+) on (twitter|linkedin|instagram|facebook|tiktok|youtube|x\.com|social media)\b",
    r"\bconnect with (him|her|them|us)\b",
    r"\bfind (him|her|them|us) on\b",
    r"\breach (him|her|them|us) at\b",
    r"\b(follow|connect) on (twitter|linkedin|instagram|facebook)\b",
    r"\bviews? (expressed|stated|shared)\b",
    r"\bopinions? (expressed|stated|are) (his|her|their) own\b",
    r"\b(guest (post|author|contributor|blogger))\b",
    r"\b(affiliate|sponsored|disclosure|disclaimer)\b",
    r"^(share|tweet|pin|post|email) (this|it|article|post|page)",
    r"^(subscribe|sign up|join) (to|for|our)\b",
    r"^(read more|learn more|find out more|discover more|see more)\b",
    r"^(click here|tap here) to\b",
    r"^(last updated|originally published|updated on|published on)",
    r"^(tags|categories|filed under|posted in|topics?):",
    r"^related (articles?|posts?|content|reading):",
    r"^(you might (also )?(like|enjoy|want to read))",
)

#: Traces of pages that scripts build. The last three without case.
SCRIPT_TRACES = (
    r"__NEXT_DATA__",
    r"id=[\"']__next[\"']",
    r"id=[\"']__nuxt[\"']",
    r"id=[\"']root[\"'](?!\w)",
    r"id=[\"']app[\"'](?!\w)",
    r"data-reactroot",
    r"data-ng-|ng-version",
    r"data-v-\w{7,}",
    r"_app\.[a-f0-9]{8,}\.js",
    r"runtime\.[a-f0-9]{8,}\.js",
    r"chunk\.[a-f0-9]{8,}\.js",
    r"(?i:\bwebpack\b)",
    r"(?i:\bvite\b)",
    r"(?i:\bnuxt\b)",
)

#: Kinds of pages by their small-letter addresses, in the order in which they are tried.
PAGE_TYPES = (
    ("blog", r"/blog/|/posts?/|/articles?/|/insights/|/news/"),
    ("product", r"/product/|/products/|/features?/|/capability"),
    ("commercial", r"/pricing|/demo|/trial|/request|/free-trial|/get-started"),
    ("service", r"/services?/|/solutions?/|/offerings?/"),
    ("resource", r"/resources?/|/category/|/topics?/|/library/|/hub/"),
    ("case-study", r"/case-stud|/customer|/success-stor"),
    ("company", r"/about|/team|/careers?|/company|/who-we-are"),
    ("comparison", r"/comparison|/vs/|/alternative|/compare"),
    ("informational", r"/glossary|/definition|/what-is|/guide|/tutorial"),
)
OTHER_PAGE_TYPE = "general"
MONEY_TYPES = ("product", "commercial", "service")

#: Names of links between kinds of pages; others are called source-to-target.
LINK_TYPES = {
    ("blog", "service"): "Blog-to-service",
    ("blog", "product"): "Blog-to-product",
    ("blog", "commercial"): "Blog-to-commercial",
    ("blog", "resource"): "Blog-to-category",
    ("blog", "blog"): "Blog-to-blog",
    ("blog", "informational"): "Blog-to-guide",
    ("blog", "comparison"): "Blog-to-comparison",
    ("informational", "product"): "Guide-to-product",
    ("informational", "service"): "Guide-to-service",
    ("product", "blog"): "Product-to-blog",
    ("resource", "blog"): "Category-to-blog",
    ("resource", "product"): "Category-to-product",
}

#: Where a site's sitemap is looked for, after what robots.txt names.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap-index.xml", "/news-sitemap.xml", "/page-sitemap.xml", "/post-sitemap.xml")
#: File endings of addresses that are no pages.
NO_PAGE_ENDINGS = tuple("jpg jpeg png gif webp svg pdf zip mp4 mp3 css js json xml rss atom ico woff woff2 ttf".split())

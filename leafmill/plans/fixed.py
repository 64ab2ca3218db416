"""Fixed values of URL planning, in their natural order."""

from __future__ import annotations

# Routing rules, first hit wins; a prompt no rule fits is "general".
RULES = [
    ("books", ["book", "read", "literature", "library"]),
    ("quotes", ["quote", "motivation", "inspire", "wisdom"]),
    ("jobs", ["job", "career", "hire", "work", "employ"]),
    ("news", ["news", "article", "headline", "current"]),
    ("products", ["product", "shop", "ecommerce", "price", "laptop", "phone"]),
]
GENERAL = "general"

# Rules whose one target is expanded over page numbers.
PAGED_RULES = ["books", "quotes"]
PAGE_COUNT = 10

# Target (url, source name, description, expected elements) per rule.
TARGETS = {
    "books": [
        (
            "https://books.toscrape.com/catalogue/page-{n}.html",
            "Books Page {n}",
            "Book titles, prices, ratings",
            ["h3", "p.price_color", "p.star-rating"],
        ),
    ],
    "quotes": [
        (
            "https://quotes.toscrape.com/page/{n}/",
            "Quotes Page {n}",
            "Quotes with authors and tags",
            ["span.text", "small.author", "a.tag"],
        ),
    ],
    "jobs": [
        (
            "https://realpython.github.io/fake-jobs/",
            "Fake Jobs",
            "Job listings",
            ["h2", "h3", "p.location"],
        ),
        (
            "https://news.ycombinator.com/jobs",
            "HN Jobs",
            "Tech job listings",
            ["a.titleline", "span.titleline"],
        ),
    ],
    "news": [
        (
            "https://news.ycombinator.com",
            "HackerNews Front",
            "Tech news",
            ["span.titleline", "a"],
        ),
        (
            "https://news.ycombinator.com/newest",
            "HN Newest",
            "Latest stories",
            ["span.titleline", "a"],
        ),
        ("https://lobste.rs", "Lobsters", "Tech stories", ["a.u-url", "span.tags"]),
        ("https://lite.cnn.com", "CNN Lite", "Headlines", ["li", "a"]),
        ("https://text.npr.org", "NPR Text", "NPR headlines", ["li", "a"]),
    ],
    "products": [
        (
            "https://webscraper.io/test-sites/e-commerce/allinone",
            "WebScraper E-Commerce",
            "Products",
            ["a.title", "h4", "span.price"],
        ),
        (
            "https://webscraper.io/test-sites/e-commerce/allinone/computers/laptops",
            "Laptops",
            "Laptop products",
            ["a.title", "h4", "span.price"],
        ),
        (
            "https://webscraper.io/test-sites/e-commerce/allinone/phones",
            "Phones",
            "Phone products",
            ["a.title", "h4", "span.price"],
        ),
        (
            "https://books.toscrape.com",
            "Books Store",
            "Books with prices",
            ["h3", "p.price_color"],
        ),
    ],
    "general": [
        (
            "https://en.wikipedia.org/wiki/{topic}",
            "Wikipedia",
            "Wikipedia article on {prompt}",
            ["h1", "h2", "h3", "p", "table", "li"],
        ),
        (
            "https://news.ycombinator.com",
            "HackerNews",
            "Tech headlines",
            ["span.titleline", "a"],
        ),
        (
            "https://quotes.toscrape.com",
            "Quotes",
            "Quotes data",
            ["span.text", "small.author"],
        ),
        ("https://books.toscrape.com", "Books", "Books data", ["h3", "p.price_color"]),
        ("https://lobste.rs", "Lobsters", "Tech stories", ["a.u-url"]),
    ],
}

# The parts of a plan that do not depend on the prompt.
TOPIC_LENGTH = 50
PROJECT_PREFIX = "Data collection for: "
DATA_TYPE = "mixed"
TARGET_COLUMNS = ["source", "type", "text", "href", "extra"]
STRATEGY = "multi-source"
ESTIMATED_ROWS = "500"

# The catalogue of free sources (category, URL template, description).
CATALOG = [
    ("News & Articles", "https://news.ycombinator.com", "Tech news headlines"),
    ("News & Articles", "https://news.ycombinator.com/newest", "Latest tech stories"),
    ("News & Articles", "https://lite.cnn.com", "CNN headlines (lightweight)"),
    ("News & Articles", "https://text.npr.org", "NPR news in text format"),
    ("News & Articles", "https://www.reddit.com/r/{subreddit}.json", "Reddit posts as JSON"),
    ("News & Articles", "https://lobste.rs", "Tech stories"),
    (
        "Books & Quotes",
        "https://books.toscrape.com",
        "Fake bookstore (titles, prices, ratings)",
    ),
    (
        "Books & Quotes",
        "https://books.toscrape.com/catalogue/page-{n}.html",
        "Paginated books",
    ),
    (
        "Books & Quotes",
        "https://quotes.toscrape.com",
        "Famous quotes with authors & tags",
    ),
    ("Books & Quotes", "https://quotes.toscrape.com/page/{n}/", "Paginated quotes"),
    (
        "Products & E-Commerce (practice sites)",
        "https://webscraper.io/test-sites/e-commerce/allinone",
        "Products",
    ),
    (
        "Products & E-Commerce (practice sites)",
        "https://webscraper.io/test-sites/e-commerce/allinone/computers/laptops",
        "Laptops",
    ),
    (
        "Products & E-Commerce (practice sites)",
        "https://webscraper.io/test-sites/e-commerce/allinone/phones",
        "Phones",
    ),
    (
        "Products & E-Commerce (practice sites)",
        "https://scrapingclub.com/exercise/list_basic/",
        "Products list",
    ),
    (
        "Jobs",
        "https://realpython.github.io/fake-jobs/",
        "Fake job listings (titles, companies, locations)",
    ),
    ("Wikipedia", "https://en.wikipedia.org/wiki/{topic}", "Any topic's Wikipedia page"),
    ("Wikipedia", "https://en.wikipedia.org/wiki/Special:Random", "Random article"),
    (
        "Code & Tech",
        "https://api.github.com/search/repositories?q={topic}&sort=stars",
        "GitHub repos",
    ),
    ("Code & Tech", "https://api.github.com/search/topics?q={topic}", "GitHub topics"),
    (
        "Code & Tech",
        "https://api.stackexchange.com/2.3/search?order=desc&sort=votes&intitle={topic}&site=stackoverflow",
        "StackOverflow",
    ),
    ("Movies & Entertainment", "https://www.imdb.com/chart/top/", "Top 250 movies"),
    ("Movies & Entertainment", "https://www.imdb.com/chart/moviemeter/", "Most popular movies"),
    ("Recipes", "https://www.allrecipes.com/search?q={topic}", "Recipe search"),
    ("Data & Statistics", "https://www.worldometers.info/", "World statistics"),
    ("Data & Statistics", "https://www.numbeo.com/cost-of-living/", "Cost of living data"),
    ("Health & Fitness", "https://www.bodybuilding.com/exercises", "Exercise database"),
]

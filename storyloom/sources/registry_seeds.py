"""Built-in sources."""

# --- fixed values: kind, class, name, feed, homepage, topic hints, quality[, tier, family, poll, author rule] ---
SEEDS = [
    ("rss", "news", "ESPN NBA", "https://www.espn.com/espn/rss/nba/news", "https://www.espn.com/nba/", ["nba"], 0.85),
    ("rss", "news", "Yahoo Sports NBA", "https://sports.yahoo.com/nba/rss/", "https://sports.yahoo.com/nba/", ["nba"], 0.8),
    ("rss", "news", "CBS Sports NBA", "https://www.cbssports.com/rss/headlines/nba/", "https://www.cbssports.com/nba/", ["nba"], 0.8),
    ("substack", "longform", "Marc Stein", "https://marcstein.substack.com/feed", "https://marcstein.substack.com", ["nba"], 0.9),
    ("rss", "news", "TechCrunch", "https://techcrunch.com/feed/", "https://techcrunch.com", ["tech", "vc"], 0.8),
    ("rss", "news", "The Verge", "https://www.theverge.com/rss/index.xml", "https://www.theverge.com", ["tech"], 0.8),
    ("rss", "news", "Ars Technica", "https://feeds.arstechnica.com/arstechnica/index", "https://arstechnica.com", ["tech", "science"], 0.85),
    ("rss", "longform", "Stratechery", "https://stratechery.com/feed/", "https://stratechery.com", ["tech"], 0.95),
    ("substack", "longform", "Noahpinion", "https://www.noahpinion.blog/feed", "https://www.noahpinion.blog", ["tech", "us-politics", "business"], 0.85),
    ("substack", "longform", "Lenny's Newsletter", "https://www.lennysnewsletter.com/feed", "https://www.lennysnewsletter.com", ["tech", "vc"], 0.8),
    ("substack", "longform", "The Pragmatic Engineer", "https://newsletter.pragmaticengineer.com/feed", "https://newsletter.pragmaticengineer.com", ["tech"], 0.85),
    ("substack", "longform", "Not Boring", "https://www.notboring.co/feed", "https://www.notboring.co", ["tech", "vc"], 0.8),
    ("rss", "longform", "Platformer", "https://www.platformer.news/rss/", "https://www.platformer.news", ["tech", "media"], 0.85),
    ("substack", "longform", "Newcomer", "https://www.newcomer.co/feed", "https://www.newcomer.co", ["vc", "tech"], 0.85),
    ("rss", "news", "Taipei Times", "https://www.taipeitimes.com/xml/index.rss", "https://www.taipeitimes.com", ["taiwan"], 0.8),
    ("rss", "longform", "Frozen Garlic", "https://frozengarlic.wordpress.com/feed/", "https://frozengarlic.wordpress.com", ["taiwan"], 0.85),
    ("rss", "longform", "Taiwan Insight", "https://www.taiwaninsight.org/feed", "https://www.taiwaninsight.org", ["taiwan"], 0.8),
    ("rss", "longform", "Ketagalan Media", "https://ketagalanmedia.com/feed/", "https://ketagalanmedia.com", ["taiwan"], 0.75),
    ("rss", "longform", "Global Taiwan Institute", "https://globaltaiwan.org/feed/", "https://globaltaiwan.org", ["taiwan"], 0.8),
    ("rss", "news", "Politico", "https://rss.politico.com/politics-news.xml", "https://www.politico.com", ["us-politics"], 0.85),
    ("rss", "news", "NPR Politics", "https://feeds.npr.org/1014/rss.xml", "https://www.npr.org/sections/politics/", ["us-politics"], 0.85),
    ("rss", "news", "NYT Politics", "https://rss.nytimes.com/services/xml/rss/nyt/Politics.xml", "https://www.nytimes.com/section/politics", ["us-politics"], 0.9),
    ("rss", "news", "The Hill", "https://thehill.com/homenews/feed/", "https://thehill.com", ["us-politics"], 0.75),
    ("substack", "longform", "Slow Boring", "https://www.slowboring.com/feed", "https://www.slowboring.com", ["us-politics"], 0.85),
    ("substack", "longform", "Silver Bulletin", "https://www.natesilver.net/feed", "https://www.natesilver.net", ["us-politics"], 0.85),
    ("substack", "longform", "The Bulwark", "https://www.thebulwark.com/feed", "https://www.thebulwark.com", ["us-politics"], 0.75),
    ("rss", "news", "BBC World", "https://feeds.bbci.co.uk/news/world/rss.xml", "https://www.bbc.com/news/world", ["world"], 0.85),
    ("rss", "news", "The New York Times", "https://rss.nytimes.com/services/xml/rss/nyt/HomePage.xml", "https://www.nytimes.com", ["world", "us-politics"], 0.9),
    ("rss", "news", "Bloomberg Markets", "https://feeds.bloomberg.com/markets/news.rss", "https://www.bloomberg.com/markets", ["business", "world"], 0.96),
    ("rss", "news", "Bloomberg Technology", "https://feeds.bloomberg.com/technology/news.rss", "https://www.bloomberg.com/technology", ["tech", "business"], 0.96),
    ("rss", "news", "WSJ World", "https://feeds.content.dowjones.io/public/rss/RSSWorldNews", "https://www.wsj.com/world", ["world", "us-politics"], 0.95),
    ("rss", "news", "WSJ Markets", "https://feeds.content.dowjones.io/public/rss/RSSMarketsMain", "https://www.wsj.com/finance", ["business"], 0.95),
    ("rss", "news", "CNBC", "https://search.cnbc.com/rs/search/combinedcms/view.xml?partnerId=wrss01&id=100003114", "https://www.cnbc.com", ["business", "us-politics", "world"], 0.9),
    ("hn", "social", "Hacker News", "topstories", "https://news.ycombinator.com", ["tech"], 0.7),
    ("x", "social", "X — Curated Journalists", "curated:journalists-v1", "https://x.com", ["world", "us-politics", "business", "tech"], 0.78, "social", "x-curated", 5, True),
    ("bluesky", "social", "AP News", "apnews.com", "https://bsky.app/profile/apnews.com", ["world", "us-politics"], 0.85),
    ("bluesky", "social", "Reuters", "reuters.com", "https://bsky.app/profile/reuters.com", ["world"], 0.85),
    ("bluesky", "social", "Aaron Rupar", "atrupar.com", "https://bsky.app/profile/atrupar.com", ["us-politics"], 0.6),
    ("bluesky", "social", "Casey Newton", "caseynewton.bsky.social", "https://bsky.app/profile/caseynewton.bsky.social", ["tech", "media"], 0.75),
    ("bluesky", "social", "ESPN", "espn.com", "https://bsky.app/profile/espn.com", ["nba"], 0.7),
    ("bluesky", "social", "Nate Silver", "natesilver.bsky.social", "https://bsky.app/profile/natesilver.bsky.social", ["us-politics"], 0.75),
    ("bluesky", "social", "Marc Stein (Bluesky)", "steinline.bsky.social", "https://bsky.app/profile/steinline.bsky.social", ["nba"], 0.8),
]

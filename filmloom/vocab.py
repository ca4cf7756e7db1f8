"""Results depend on these exact words, so they are listed in plain form."""

GENRES = ["Action", "Adventure", "Animation", "Children", "Comedy", "Crime", "Documentary", "Drama",
          "Fantasy", "Film-Noir", "Horror", "IMAX", "Musical", "Mystery", "Romance", "Sci-Fi",
          "Thriller", "War", "Western"]

LANGUAGES = ["ar", "bm", "bn", "bo", "bs", "cs", "da", "de", "el", "en", "es", "fa", "fi", "fr", "he",
             "hi", "hu", "id", "is", "it", "iu", "ja", "ka", "ko", "ku", "mk", "mn", "nl", "no", "pl",
             "pt", "ro", "ru", "sk", "sr", "sv", "ta", "th", "tl", "tn", "tr", "vi", "zh"]

ALERT_CODES = ["QUERY_UNCLEAR", "NOT_MOVIE_REQUEST", "UNSUPPORTED_REQUEST"]

CONTROL_CODES = ["INVALID_REQUEST", "QUERY_UNCLEAR", "LANGUAGE_MISMATCH", "NOT_MOVIE_REQUEST",
                 "UNSUPPORTED_REQUEST", "NO_RESULTS", "RATE_LIMITED", "PARSER_INVALID_RESPONSE",
                 "PROVIDER_UNAVAILABLE", "SEARCH_UNAVAILABLE", "INTERNAL_ERROR"]

UNCHANGED_ALLOWED = ["cgi", "imax", "pixar", "disney", "3d", "2d", "dvd", "vhs", "noir", "imdb"]
AMBIGUOUS_SEEDS = ["camp", "gritty", "quirky", "twist", "feel-good", "mind-bending"]

REVIEW_STATUSES = ["auto_pass", "review_required", "reviewed"]
EVALUATION_MODES = ["structured", "semantic", "hybrid"]
EVALUATION_SCHEMA = "phase-d-proposed-v1"
DETAIL_CACHE_VERSION = "tmdb-cache-v2"

POSTER_BASE = "https://image.tmdb.org/t/p/w500"
TITLE_URL_BASE = "https://www.imdb.com/title/tt"

MAX_SAFE_INTEGER = 9007199254740991
RESULT_LIMIT = 10

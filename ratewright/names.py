"""Column names, file names and default settings shared by all operators."""

# Columns of the interaction log and of the submission and solution tables.
USER = "user_id"
BOOK = "book_id"
HAS_READ = "has_read"
RATING = "rating"
TIMESTAMP = "timestamp"
SOURCE = "source"
PREDICTION = "rating_predict"
STAGE = "stage"
PAIR = [USER, BOOK]

# Metadata columns.
GENDER = "gender"
AGE = "age"
TITLE = "title"
AUTHOR = "author_id"
AUTHOR_NAME = "author_name"
YEAR = "publication_year"
LANGUAGE = "language"
PUBLISHER = "publisher"
AVG_RATING = "avg_rating"
GENRE = "genre_id"
GENRE_NAME = "genre_name"
BOOKS_COUNT = "books_count"
DESCRIPTION = "description"

# Derived feature columns.
USER_MEAN = "user_mean_rating"
USER_COUNT = "user_ratings_count"
BOOK_MEAN = "book_mean_rating"
BOOK_COUNT = "book_ratings_count"
AUTHOR_MEAN = "author_mean_rating"
GENRES_COUNT = "book_genres_count"

# Row origins, stages and markers for missing categories.
TRAIN = "train"
TEST = "test"
PUBLIC = "public"
PRIVATE = "private"
MISSING_TEXT = "-1"
MISSING_NUMBER = -1

# Rating range and the file names of a raw data folder.
RATING_MIN = 0
RATING_MAX = 10
FILES = {
    "train": "train.csv",
    "test": "test.csv",
    "users": "users.csv",
    "books": "books.csv",
    "book_genres": "book_genres.csv",
    "genres": "genres.csv",
    "book_descriptions": "book_descriptions.csv",
}

# Default settings.
SPLIT_RATIO = 0.8
TFIDF_MAX_FEATURES = 10_000
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95
ENCODER_BATCH = 8
EMBEDDING_DIM = 768
EARLY_STOPPING_ROUNDS = 100
SEED = 42

# Explicit file order of tables in which a key may repeat. Spark rows carry no order of their own.
ROW_ORDER = "row_order"

# Vector columns that this library adds.
TFIDF = "tfidf"
EMBEDDING = "embedding"

CATEGORICAL = [USER, BOOK, GENDER, AGE, AUTHOR, YEAR, LANGUAGE, PUBLISHER]
TEXT_CATEGORIES = [GENDER, LANGUAGE, PUBLISHER]
FREE_TEXT = [TITLE, AUTHOR_NAME]
NOT_FEATURES = [SOURCE, RATING, PREDICTION, TIMESTAMP]

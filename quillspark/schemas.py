"""Table shapes."""

from pyspark.sql import types as T

#: A card: a piece of a book with its place in the book's characters. ``ord`` is the place among the book's cards.
CARD = T.StructType([T.StructField("author", T.StringType()), T.StructField("title", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("translation", T.StringType())])
REQUIRED = ("author", "title", "start", "end", "text")

#: Bands of frequency ranks; a word's level is the number of its band.
LEVELS = [(0, 1000), (1000, 2000), (2000, 5000), (5000, 10000), (10000, 20000), (20000, 99999999)]

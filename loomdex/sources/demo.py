"""Ten documents to try queries on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The demonstration documents and queries.
DOCUMENTS = [
    ("doc1", "The Cat in the Hat", "A cat wearing a tall striped hat causes chaos in a house while the children's mother is away"),
    ("doc2", "Dog Days of Summer", "A story about a lazy dog enjoying the warm summer days in the backyard"),
    ("doc3", "Cat and Dog Friends", "A tale of unlikely friendship between a cat named Whiskers and a dog named Buddy"),
    ("doc4", "Birds of Paradise", "Documentary about exotic birds living in tropical rainforests"),
    ("doc5", "The Fish Tank", "Guide to maintaining a healthy aquarium with tropical fish"),
    ("doc6", "Война и мир", "Роман Льва Толстого о войне и мире в России начала XIX века"),
    ("doc7", "Преступление и наказание", "Роман Достоевского о студенте Раскольникове и его преступлении"),
    ("doc8", "Programming Cats", "A book about how cats would write code if they could program computers"),
    ("doc9", "Summer Vacation", "Planning the perfect summer vacation with family and friends"),
    ("doc10", "Winter Dogs", "How dogs adapt to cold winter weather and snow"),
]
QUERIES = ["cat", "cat AND dog", "cat OR dog", "(cat OR dog) AND NOT summer", "война", "fish OR bird"]


def demo_documents(spark: SparkSession) -> DataFrame:
    """(at, external_id, title, content), `at` giving the order."""
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DOCUMENTS)], "at long, external_id string, title string, content string")

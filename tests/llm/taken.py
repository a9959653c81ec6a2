"""A frame that takes the function which a task would run."""

from pyspark.sql.pandas.types import from_arrow_schema


class Taken:
    def __init__(self, schema):
        self.arrow, self.schema, self.columns, self.function = schema, from_arrow_schema(schema), schema.names, None

    def drop(self, *names):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self

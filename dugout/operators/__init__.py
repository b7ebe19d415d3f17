"""Table operators: DataFrame in, DataFrame out, with key and order columns as arguments."""

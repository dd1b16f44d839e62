"""graphloom: analytics over typed entities and their links, as Spark DataFrame plans."""

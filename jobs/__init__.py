"""Jobs with a command line; they take plain paths and read and write through Spark."""

"""End-to-end builds: conformed tables, history books and the step-wise base table."""

"""riskmart: credit-risk feature marts and scoring reports as Spark DataFrame operators."""

from tidewheel.functions.summarizers import (
    Correlation, Count, Covariance, DotProduct, First, FoldSummarizer, Last, Max, Mean, Min, Moment, Product, Std, Sum, Summarizer, SumPower, Variance,
)

__all__ = [
    "Correlation", "Count", "Covariance", "DotProduct", "First", "FoldSummarizer", "Last", "Max", "Mean", "Min", "Moment", "Product", "Std", "Sum", "SumPower", "Summarizer", "Variance",
]

"""binsight: Spark-native reports and data-quality operators for weighed
waste deposits and collection-station events.

Every public function takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing is collected to the driver.  See README.md.
"""

from binsight.session import get_spark

__all__ = ["get_spark"]

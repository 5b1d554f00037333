"""Line-table analytics for digitised early prints, expressed as Spark plans."""

"""quadloom.sinks"""
